"""BPE encoding and decoding; long texts are encoded in parts by many tasks and concatenated as a tree.

A text of up to ``part_chars`` code points is encoded where it lies. A longer one is halved until its parts are that
short, wherever the halves fall, the parts are dealt to tasks and encoded there as texts of their own, and then joined
pairwise. A join re-encodes a window around the place where two parts meet, which grows until both sides agree:

* pieces. A piece of the left part is a piece of the whole text unless it is one of its last two (what follows can only
  add to the last, take one white space from it, or make a contraction of the last two). From the third-last piece on, the
  window's text is split again together with more and more of the right part. Once a piece that is not one of the window's
  last two starts where a piece of the right part starts, all later pieces are those of the right part.
* tokens. A piece of the window made of the end of one long piece and the start of another is not encoded anew as a whole:
  a window of tokens around the meeting place is, doubled on a side until its first and its last token are those that the
  parts have there. All pairs of neighbours then stand in a valid encoding, so the whole is the encoding.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBPE, byte_bpe
from .common import table, written

#: Longest text, in code points, that one task encodes in one go.
PART_CHARS = 65_536
#: Pieces of the right part that the first window holds; doubled while the sides disagree.
FIRST_WINDOW = 8
#: Longer pieces are joined token by token instead of encoded anew.
LONG_PIECE = 256


class Part:
    """An encoded text: its pieces and the packed ids of each."""

    def __init__(self, pieces: list[str], ids: list[bytes]):
        self.pieces, self.ids = pieces, ids

    @classmethod
    def of(cls, bpe: ByteBPE, text: str) -> Part:
        pieces = bpe.split(text)
        return cls(pieces, [encode_long(bpe, p) if len(p) > LONG_PIECE else bpe.packed[p] for p in pieces])


def encode_long(bpe: ByteBPE, piece: str) -> bytes:
    """Ids of one unsplit piece, halves first."""
    raw = piece.encode()
    return np.array(_halved(bpe, raw), dtype="<u4").tobytes()


def _halved(bpe: ByteBPE, raw: bytes) -> list[int]:
    if len(raw) <= LONG_PIECE:
        return bpe.encode_piece(raw)
    middle = len(raw) // 2
    return join_tokens(bpe, _halved(bpe, raw[:middle]), _halved(bpe, raw[middle:]))


def join_tokens(bpe: ByteBPE, left: list[int], right: list[int]) -> list[int]:
    """The encoding of one piece from those of its two halves, which may meet anywhere, even inside a character."""
    if not left or not right:
        return left or right
    size = bpe.bytes_of
    a = b = 2
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        window = bpe.encode_piece(b"".join(size[t] for t in left[-a:] + right[:b]))
        left_agrees = a == len(left) or window[0] == left[-a]
        right_agrees = b == len(right) or window[-1] == right[b - 1]
        if left_agrees and right_agrees:
            return left[: len(left) - a] + window + right[b:]
        a, b = a if left_agrees else 2 * a, b if right_agrees else 2 * b


def join(bpe: ByteBPE, left: Part, right: Part) -> Part:
    """The encoding of the concatenated text."""
    if not left.pieces or not right.pieces:
        return left if left.pieces else right
    keep = max(0, len(left.pieces) - 3)
    tail = "".join(left.pieces[keep:])
    starts = [len(tail), *(len(tail) + n for n in accumulate(map(len, right.pieces)))]  # of the right part's pieces, and its end
    taken = FIRST_WINDOW
    while True:
        taken = min(taken, len(right.pieces))
        window = bpe.split(tail + "".join(right.pieces[:taken]))
        sure = len(window) if taken == len(right.pieces) else len(window) - 2
        at, found = 0, None
        for k in range(sure + 1):
            j = bisect_left(starts, at)
            if at >= len(tail) and j < len(starts) and starts[j] == at:
                found = (k, j)
                break
            at += len(window[k]) if k < len(window) else 0
        if found:
            break
        taken *= 2
    k, j = found
    ids, at = [], 0
    for piece in window[:k]:
        end = at + len(piece)
        last = left.pieces[-1]
        if at == len(tail) - len(last) and end == starts[1] and len(piece) > LONG_PIECE:
            old = [np.frombuffer(x, "<u4").tolist() for x in (left.ids[-1], right.ids[0])]
            ids.append(np.array(join_tokens(bpe, *old), dtype="<u4").tobytes())
        else:
            ids.append(encode_long(bpe, piece) if len(piece) > LONG_PIECE else bpe.packed[piece])
        at = end
    return Part(left.pieces[:keep] + window[:k] + right.pieces[j:], left.ids[:keep] + ids + right.ids[j:])


def tree(bpe: ByteBPE, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [join(bpe, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def cut(text: str, part_chars: int) -> list[str]:
    """Halves of halves, each of at most ``part_chars``."""
    if len(text) <= part_chars:
        return [text]
    middle = len(text) // 2
    return cut(text[:middle], part_chars) + cut(text[middle:], part_chars)


def encode(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """One row per input row: key, ids binary (little-endian unsigned 32-bit integers), decoded string.

    Ids are the library's with add_special_tokens=False; the strings of special tokens inside texts become those tokens.
    decoded is made from the ids, with special tokens kept. Null text counts as empty: no ids. Null and repeated keys pass
    through, a row each (long texts are told apart by a row number of their own); other columns are not read.

    Texts of up to ``part_chars`` never move. Parts of longer ones are shuffled by text and part, so that the parts of one
    text go to many tasks; then their pieces and ids meet in one task for each text, whose size bounds that task."""
    out = df.select(key).schema.add("ids", "binary").add("decoded", "string")
    names = [f.name for f in out]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def finished(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        bpe = byte_bpe(tokenizer)
        decoded = [bpe.decode(np.frombuffer(x, "<u4")) for x in ids]
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=names)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            yield finished(batch.column(0), [bpe.encode(t) for t in batch.column(1).to_pylist()])

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n = 0
                for plain, special in bpe.segments(row.column(2)[0].as_py()):
                    cuts = cut(plain, part_chars)
                    for c, part in enumerate(cuts):
                        ends = special if c + 1 == len(cuts) and special is not None else -1
                        one = [row.column(0), row.column(1), pa.array([n], pa.int32()), pa.array([c == 0]), pa.array([ends], pa.int32()), pa.array([part])]
                        yield pa.RecordBatch.from_arrays(one, names=["row", key, "n", "first", "special", "part"])
                        n += 1

    def part_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            encoded = [Part.of(bpe, t) for t in batch.column(5).to_pylist()]
            columns = [*batch.columns[:5], pa.array([p.pieces for p in encoded], pa.list_(pa.string())), pa.array([p.ids for p in encoded], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", key, "n", "first", "special", "pieces", "ids"])

    def joined(rows: pa.Table) -> pa.Table:
        bpe = byte_bpe(tokenizer)
        rows = rows.sort_by("n").combine_chunks()
        first, specials = rows["first"].to_pylist(), rows["special"].to_pylist()
        ids: list[bytes] = []
        parts: list[Part] = []
        for n, special in enumerate(specials):
            parts = [*([] if first[n] else parts), Part(rows["pieces"][n].as_py(), rows["ids"][n].as_py())]
            if n + 1 == len(first) or first[n + 1]:
                ids += tree(bpe, parts).ids
                if special >= 0:
                    ids.append(special.to_bytes(4, "little"))
        return pa.Table.from_batches([finished(rows[key][:1].combine_chunks(), [b"".join(ids)])])

    short = df.select(F.col(key), whole.alias("text")).where(F.length("text") <= part_chars).mapInArrow(at_once, out)
    long = df.select(F.expr("uuid()").alias("row"), F.col(key), whole.alias("text")).where(F.length("text") > part_chars)
    kind = df.schema[key].dataType.simpleString()
    head = f"row string, {_quoted(key)} {kind}, n int, first boolean, special int"
    parts = written(
        long.mapInArrow(parts_of, f"{head}, part string"), "parts"
    )  # uuid() differs when a lost task runs again, so it is settled in a table
    ids = parts.repartition("row", "n").mapInArrow(part_ids, f"{head}, pieces array<string>, ids array<binary>")
    return short.unionByName(ids.groupBy("row").applyInArrow(joined, out))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def digests(encoded: DataFrame, key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of a table of ``encode``, and its columns named in ``extra``."""
    return encoded.select(
        key,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
        *(extra or []),
    )


def op7_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
