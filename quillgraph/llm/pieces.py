"""BPE over characters with byte fallback, merged in rounds over flat numpy arrays.

A model file fixes pieces with scores. A text, with a space in front and U+2581 for each space, starts as its characters;
of all neighbours that together are a piece, those of the highest score merge first, the leftmost of equals. Merges never
reach over a place between two characters that no piece holds side by side, so the text falls apart there into segments
that merge on their own. One round works on all segments of many words at once: the least rank among a segment's pairs is
found by a segmented minimum, its pairs merge from the left without overlap, and arrays are compacted; segments without a
pair leave. What a round does at once equals one merge after the other unless a merge makes a pair of the same or a better
rank while others of the round are waiting; such segments (runs of spaces, above all) go through a queue.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: Fixed values of the file format: kinds of pieces and the kind of a model.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
#: Symbols that are no pieces are this and their code point; pairs are two symbols of so many bits.
OTHER, BITS = 1 << 20, 22
NEVER = np.int32(2**31 - 1)


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a message of protocol buffers; 32-bit values stay bytes."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            out.append((tag >> 3, varint()))
            continue
        size = {1: 8, 5: 4}[tag & 7] if tag & 7 != 2 else varint()
        out.append((tag >> 3, data[at : at + size]))
        at += size
    return out


class Merges:
    """Pairs of symbols that merge: (left, right) -> (rank, what they become). Lower ranks merge first."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << BITS | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        ranks, made = (np.array([p[k] for p in pairs.values()], np.int64)[order] for k in (0, 1))
        self.keys = np.append(keys[order], np.int64(2**62))
        self.found = {k: n for n, k in enumerate(self.keys[:-1].tolist())}
        self.ranks, self.made = np.append(ranks.astype(np.int32), NEVER), np.append(made, 0)

    def merged(self, symbols: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """What each segment's symbols merge to, at the places where they start; -1 elsewhere."""
        out = np.full(len(symbols), -1, np.int64)
        if len(symbols):
            self._rounds(symbols, segment, out)
        return out

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table of pairs; its end where there is none."""
        key = left << BITS | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    def _rounds(self, symbol: np.ndarray, segment: np.ndarray, out: np.ndarray) -> None:
        """Puts each segment's last symbols into out, at the places where they start."""
        place = np.arange(len(symbol))
        pair = np.full(len(symbol), len(self.keys) - 1)
        inside = np.flatnonzero(segment[:-1] == segment[1:])
        pair[inside] = self._look(symbol[inside], symbol[inside + 1])
        while len(symbol):
            rank = self.ranks[pair]
            start = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            least = np.minimum.reduceat(rank, start)
            size = np.diff(np.append(start, len(symbol)))
            if (least == NEVER).any():
                on = np.repeat(least != NEVER, size)
                out[place[~on]] = symbol[~on]
                symbol, segment, place, pair, rank = symbol[on], segment[on], place[on], pair[on], rank[on]
                size, least = size[least != NEVER], least[least != NEVER]
                if not len(symbol):
                    return
            own = np.repeat(least, size)
            hit = np.flatnonzero(rank == own)  # a segment's last symbol has no pair, so runs of hits end with it
            first = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run = np.flatnonzero(first)[np.cumsum(first) - 1]
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            new = self.made[pair[hit]]
            merged = symbol.copy()
            merged[hit] = new
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            # pairs that a merge makes, with what stands to its right before the round and to its left after it
            after, before = hit + 2, np.maximum(hit - 1, 0)
            has_after = np.flatnonzero((after < len(symbol)) & (segment[np.minimum(after, len(symbol) - 1)] == segment[hit]))
            before = np.where(keep[before], before, before - 1)
            has_before = np.flatnonzero((hit > 0) & (segment[before] == segment[hit]))
            several = np.flatnonzero(segment[hit[1:]] == segment[hit[:-1]])
            if len(several):
                many = np.zeros(len(hit), bool)
                many[several], many[several + 1] = True, True
                ra, rb = has_after[many[has_after]], has_before[many[has_before]]
                bad = np.concatenate((
                    ra[self.ranks[self._look(new[ra], symbol[after[ra]])] <= own[hit[ra]]],
                    rb[self.ranks[self._look(merged[before[rb]], new[rb])] <= own[hit[rb]]],
                ))
                if len(bad):
                    queued = np.isin(segment, segment[hit[bad]])
                    self._queue(symbol[queued], segment[queued], place[queued], out)
                    symbol, segment, place, pair = symbol[~queued], segment[~queued], place[~queued], pair[~queued]
                    continue
            changed = np.zeros(len(symbol), bool)
            changed[hit] = True
            changed[before[has_before]] = True
            symbol, segment, place, pair, changed = merged[keep], segment[keep], place[keep], pair[keep], changed[keep]
            at = np.flatnonzero(changed)
            last = (at + 1 == len(symbol)) | (segment[np.minimum(at + 1, len(symbol) - 1)] != segment[at])
            pair[at[last]] = len(self.keys) - 1
            at = at[~last]
            pair[at] = self._look(symbol[at], symbol[at + 1])

    def _queue(self, symbol: np.ndarray, segment: np.ndarray, place: np.ndarray, out: np.ndarray) -> None:
        """The same for segments of which merges must come one after the other."""
        for part in np.split(np.arange(len(symbol)), np.flatnonzero(segment[1:] != segment[:-1]) + 1):
            own, n = symbol[part].tolist(), len(part)
            right, left, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
            found = self._look(symbol[part[:-1]], symbol[part[1:]])
            ranks = self.ranks[found].tolist()
            waiting = [(r, k, k + 1, 2, m) for k, (r, m) in enumerate(zip(ranks, self.made[found].tolist(), strict=True)) if r != NEVER]
            heapq.heapify(waiting)
            while waiting:
                _, a, b, both, m = heapq.heappop(waiting)
                if not size[a] or b >= n or not size[b] or right[a] != b or size[a] + size[b] != both:
                    continue
                own[a], size[a], size[b], right[a] = m, both, 0, right[b]
                if right[a] < n:
                    left[right[a]] = a
                for x, y in ((left[a], a), (a, right[a])):
                    if x >= 0 and y < n:
                        k = self.found.get(own[x] << BITS | own[y])
                        if k is not None:
                            heapq.heappush(waiting, (int(self.ranks[k]), x, y, size[x] + size[y], int(self.made[k])))
            stand = [k for k in range(n) if size[k]]
            out[place[part[stand]]] = [own[k] for k in stand]


class PieceModel:
    """The tokenizer of one file; ids equal the library's for whole texts without begin or end ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = fields(f.read())
        trainer, normalizer = (dict(fields(next((v for n, v in model if n == k), b""))) for k in (2, 3))
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or normalizer.get(2):
            raise ValueError("a BPE model with byte fallback and without character maps is needed")
        if normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1:
            raise ValueError("only models that add a space in front and keep white space are supported")
        self.pieces, scores, self.kinds = [], [], []
        for piece in (dict(fields(v)) for n, v in model if n == 1):
            self.pieces.append(piece.get(1, b"").decode())
            scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            self.kinds.append(piece.get(3, NORMAL))
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.surface = [self._surface(i, p) for i, p in enumerate(self.pieces)]
        self.symbols = np.arange(OTHER, OTHER + 0x110000, dtype=np.int64)  # of each code point
        for p, i in ids.items():
            if len(p) == 1:
                self.symbols[ord(p)] = i
        self.symbols[ord(" ")] = self.symbols[ord(SPACE)]
        rank = np.unique(-np.array(scores), return_inverse=True)[1]
        pairs = {(ids[p[:k]], ids[p[k:]]): (int(rank[i]), i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.merges = Merges(pairs)
        beside = {(ord(p[k]) << BITS | ord(p[k + 1])) for p in ids for k in range(len(p) - 1)}
        self.beside = np.append(np.sort(np.fromiter(beside, np.int64, len(beside))), np.int64(2**62))

    def _surface(self, i: int, piece: str) -> bytes:
        kind = self.kinds[i]
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other, where each word's ids start and the end of the last). A word is any text
        of whose neighbours in front and behind no merge takes part; spaces count as U+2581, none is put in front."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        code[code == ord(" ")] = ord(SPACE)
        near = code[:-1] << BITS | code[1:]
        apart = self.beside[np.searchsorted(self.beside, near)] != near
        apart[ends[(ends > 0) & (ends < len(code))] - 1] = True
        out = self.merges.merged(self.symbols[code], np.concatenate(([0], np.cumsum(apart))))
        left = np.flatnonzero(out >= 0)
        ids, sizes = self._bytes(out[left])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.concatenate(([0], offsets[np.searchsorted(left, ends)])).astype(np.int64)

    def _bytes(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them each symbol gives): a character that is no piece gives one for each of its bytes."""
        sizes, odd = np.ones(len(symbols), np.int64), np.flatnonzero(symbols >= OTHER)
        if not len(odd):
            return symbols.astype(np.int32), sizes
        raw = [chr(c - OTHER).encode("utf-8", "surrogatepass") for c in symbols[odd].tolist()]
        sizes[odd] = list(map(len, raw))
        ids = np.repeat(np.where(symbols < OTHER, symbols, -1), sizes).astype(np.int32)
        ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, sizes

    def decode(self, ids: list[int]) -> str:
        """As the library: the space in front goes, a byte that is no part of a character becomes U+FFFD; control ids give
        nothing, but characters do not reach over them."""
        runs = [ids]
        if not self.controls.isdisjoint(ids):
            cuts = [k for k, i in enumerate(ids) if i in self.controls]
            runs = [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
        raws = [b"".join(map(self.surface.__getitem__, run)) for run in runs]
        first = next((k for k, run in enumerate(runs) if run), None)
        if first is not None and self.kinds[runs[first][0]] == NORMAL and raws[first][:1] == b" ":
            raws[first] = raws[first][1:]
        return "".join(map(_text, raws))


def _text(raw: bytes) -> str:
    out = []
    while True:
        try:
            return "".join([*out, raw.decode()])
        except UnicodeDecodeError as e:
            out += [raw[: e.start].decode(), "\ufffd"]
            raw = raw[e.start + 1 :]


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """One model for each file and Python worker."""
    return PieceModel(path)
