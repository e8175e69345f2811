"""Byte-level BPE over pre-tokenised pieces, with the exact token count at every prefix of a piece.

A byte-level tokenizer file fixes a vocabulary, an ordered merge list, a split pattern and some added special strings.
Texts are cut at special strings first, then by the pattern into pieces, and each piece is encoded on its own. Real text
repeats its pieces, so everything here is computed once for each distinct piece and kept in a bounded cache.

Prefix dynamic programme. Write enc(x) for the encoding of the byte string x. A sequence of tokens is an encoding if and
only if each two neighbours are (the pair encodes to itself), so the last token of enc(p[:i]) is the one token t ending at
i whose pair with the last token of enc(p[:i - len(t)]) encodes to itself. Filling a table over i gives the last token and
the count of every prefix in one pass, and the encoding itself by walking back from the end.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

#: Fixed value: the split pattern that byte-level BPE files with ``use_regex`` stand for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of which a prefix is not one piece: the apostrophe and its letters part when the last letter goes.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Entries of a piece cache before it starts anew; a worker holds at most this many distinct pieces.
CACHE_PIECES = 600_000
#: Longer pieces are encoded but not kept.
CACHE_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """Character of the file's alphabet -> byte: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Cache(dict):
    """piece -> make(piece), bounded."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = value
        return value


class ByteBPE:
    """The tokenizer of one file. Counts and ids equal the library's for whole texts without begin or end tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        if spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError("only the plain split pattern without a prefix space is supported")
        table = byte_alphabet()
        as_bytes = lambda s: bytes(table[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if all(c in table for c in t)}
        self.specials = {}
        for t in spec.get("added_tokens") or []:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("special strings that take white space along are not supported")
            self.specials[t["content"]] = t["id"]
            self.ids.pop(as_bytes(t["content"]) if all(c in table for c in t["content"]) else b"", None)
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.token_bytes = [b""] * (max([*self.bytes_of, *self.specials.values()]) + 1)
        for i, b in self.bytes_of.items():
            self.token_bytes[i] = b
        for s, i in self.specials.items():
            self.token_bytes[i] = s.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            if left in self.ids and right in self.ids and left + right in self.ids:
                self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))
        self._made = {new: (rank, pair) for pair, (rank, new) in sorted(self.merges.items(), key=lambda m: -m[1][0])}
        for b in sorted(self.ids, key=len):  # tokens that their own bytes never give, or of which a part is such a one
            if len(b) > 1 and not self._reachable(self.ids[b]):
                del self._made[self.ids[b]], self.ids[b]
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(SPLIT).findall
        self._pairs: dict[int, bool] = {}
        self.stored = _Cache(self._stored)
        self.counts = _Cache(lambda piece: self.stored[piece][-1])
        self.packed = _Cache(lambda piece: np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes())

    # ---- one piece

    def _reachable(self, token: int) -> bool:
        if token not in self._made:
            return False
        rank, (left, right) = self._made[token]
        made = lambda t: t in self._made or len(self.bytes_of[t]) == 1
        return made(left) and made(right) and self._apart(left, right, rank)

    def _apart(self, left: int, right: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins the two tokens' bytes across the place where they meet.

        The merges that made the tokens are undone from the latest on; what then meets there must not have merged by the
        time of the one undone. Equal merges run from the left, so one undone on the right loses to the same one across."""
        while True:
            across = self.merges.get((left, right))
            if across is not None and across[0] < before:
                return False
            a, b = self._made.get(left), self._made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, left = min(before, a[0]), a[1][1]
            else:
                before, right = min(before, b[0] + 1), b[1][0]

    def _stands(self, left: int, right: int) -> bool:
        """Whether the two neighbouring tokens encode to themselves."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= 2 * CACHE_PIECES:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(left, right, 1 << 60)
        return known

    def _table(self, piece: bytes) -> tuple[list[int], list[int]]:
        last, count = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        token_of, known, stands, longest = self.ids.get, self._pairs.get, self._stands, self.longest
        for end in range(1, len(piece) + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                token = token_of(piece[start:end])
                if token is None:
                    continue
                if start:
                    left = last[start]
                    fits = known(left << 32 | token)
                    if not (stands(left, token) if fits is None else fits):
                        continue
                last[end], count[end] = token, count[start] + 1
                break
            else:
                raise ValueError("the vocabulary has no token for a byte")
        return last, count

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i from 0 to its length."""
        return self._table(piece)[1]

    def _stored(self, piece: str) -> bytes | list[int]:
        """Tokens of the first i code points of a piece for each i, in a byte each where they fit."""
        counts, data = [0], piece.encode()
        table = self.prefix_counts(data)
        if len(data) == len(piece):
            counts = table
        else:
            counts += [table[k] for k in np.cumsum([len(c.encode()) for c in piece]).tolist()]
        return bytes(counts) if max(counts) < 256 else counts

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        last, end, out = self._table(piece)[0], len(piece), []
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    # ---- one text

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """(plain text, id of the special string that follows it or None), in order; the last has None."""
        if self.special_re is None:
            return [(text, None)]
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out.append((text[at : m.start()], self.specials[m.group()]))
            at = m.end()
        return [*out, (text[at:], None)]

    def count(self, text: str) -> int:
        if self.special_re is not None and self.special_re.search(text):
            return sum(sum(map(self.counts.__getitem__, self.split(part))) + (special is not None) for part, special in self.segments(text))
        return sum(map(self.counts.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for part, special in self.segments(text):
            out += map(self.packed.__getitem__, self.split(part))
            if special is not None:
                out.append(special.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """As the library with special tokens kept; invalid UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")

    def _piece_prefixes(self, piece: str, before: str) -> list[int]:
        """Tokens of each code-point prefix of piece, less those of ``before``, the piece in front of it.

        A white-space run at the end of a text is one piece, but gives its last character to what follows, or leaves it
        alone; so the leading white space of a piece behind such a run counts together with the run."""
        if piece in CONTRACTIONS:
            return [self.count(piece[:1]), self.count(piece[:1]) + self.count(piece[1:2]), self.counts[piece]]
        own = list(self.stored[piece][1:])
        if before and before.isspace() and piece[:1].isspace():
            run = len(piece) - len(piece.lstrip())
            whole = self.stored[before + piece[:run]]
            for k in range(run if run < len(piece) else run - 1):
                own[k] = whole[len(before) + k + 1] - self.counts[before]
            if run == len(piece):
                own[run - 1] = whole[-1] - self.counts[before]
        return own

    def prefixes(self, text: str) -> np.ndarray:
        """int32 counts c with c[i] the tokens of text[:i], for i from 0 to its length in code points."""
        out, base = [0], 0
        for part, special in self.segments(text):
            literal = "" if special is None else self.token_bytes[special].decode()
            run = part + literal[:-1]  # inside a special string, what is there of it is plain text
            before, at = "", base
            for piece in self.split(run):
                out += [at + c for c in self._piece_prefixes(piece, before)]
                at, before = at + self.counts[piece], piece
            base += sum(map(self.counts.__getitem__, self.split(part)))
            if special is not None:
                base += 1
                out.append(base)
        return np.array(out, dtype=np.int32)

    def longest_fit(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens."""
        return self.measured(text, budget)[1]

    def measured(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of text, code points of its longest prefix of at most ``budget`` tokens), from one split into pieces and
        their stored counts. Counts at ends of pieces only rise, so the search looks into pieces from the last that
        starts within the budget, or from one behind it that white space joins to it: there counts fall again."""
        if self.special_re is not None and self.special_re.search(text):
            n = self.count(text)
            return n, len(text) if n <= budget else int(np.flatnonzero(self.prefixes(text) <= budget)[-1]) if budget > 0 else 0
        pieces = self.split(text)
        sizes = list(map(self.counts.__getitem__, pieces))
        n = sum(sizes)
        if n <= budget:
            return n, len(text)
        if budget <= 0:
            return n, 0
        starts = list(accumulate(sizes, initial=0))
        last = bisect_right(starts, budget, hi=len(pieces)) - 1
        while last + 1 < len(pieces) and pieces[last].isspace() and pieces[last + 1][:1].isspace():
            last += 1
        for k in range(last, -1, -1):
            own = self._piece_prefixes(pieces[k], pieces[k - 1] if k else "")
            fits = [j for j, c in enumerate(own, 1) if starts[k] + c <= budget]
            if fits:
                return n, sum(map(len, pieces[:k])) + fits[-1]
        return n, 0


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """One tokenizer for each file and Python worker."""
    return ByteBPE(path)
