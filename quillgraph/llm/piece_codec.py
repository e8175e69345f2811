"""SentencePiece BPE encoding and decoding by vectorised merge rounds (``pieces``).

Texts are cut into words, a run of spaces and what follows it, of which no merge reaches into the next. Real text repeats
its words, so a worker keeps the ids of those it has met, numbered, in one flat array; only the words of a slice of texts
that are new go through the merge rounds, all at once. A text's ids are then gathered by its words' numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table
from .pieces import PieceModel, piece_model

#: Code points of texts that are worked on at once (one longer text is a slice of its own).
SLICE_CHARS = 1 << 20
#: Words, and their code points, that a worker keeps before it starts anew.
KEPT_WORDS, KEPT_CHARS = 300_000, 6_000_000

words_of = re.compile("[ ▁]+[^ ▁]*").findall


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of several ranges of a flat array, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - np.concatenate(([0], ends[:-1])), sizes) + np.arange(ends[-1] if len(ends) else 0)


class KnownWords:
    """word -> number, and the ids of all of them; bounded."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.chars, self.ids, self.at = 0, [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.whole = None

    def learn(self, words: list[str]) -> None:
        """Makes all of these known; numbers given before may no longer hold."""
        new = [w for w in set(words) if w not in self.numbers]
        if len(self.numbers) + len(new) > KEPT_WORDS or self.chars + sum(map(len, new)) > KEPT_CHARS:
            self._clear()
            new = list(set(words))
        if new:
            ids, at = self.model.encode_words(new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
            self.ids.append(ids)
            self.at.append(at[1:] + self.at[-1][-1])
            self.chars += sum(map(len, new))
            self.whole = None

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of known words, how many of them each word gives)."""
        if self.whole is None:
            self.whole = np.concatenate(self.ids), np.concatenate(self.at)
            self.ids, self.at = [self.whole[0]], [self.whole[1]]
        ids, at = self.whole
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        sizes = at[number + 1] - at[number]
        return ids[gathered(at[number], sizes)], sizes


def encode_texts(known: KnownWords, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, where each text's ids start and the end of the last)."""
    words, counts = [], []
    for t in texts:
        own = words_of(" " + t) if t else []
        words += own
        counts.append(len(own))
    known.learn(words)
    ids, sizes = known.ids_of(words)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return ids, ends[np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))]


def char_slices(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows that have about ``most`` code points together."""
    at, texts, chars = 0, [], 0
    for k in range(len(column)):
        texts.append(column[k].as_py())
        chars += len(texts[-1])
        if chars >= most:
            yield at, texts
            at, texts, chars = k + 1, [], 0
    if texts:
        yield at, texts


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ids array<int>, decoded string.

    Ids are the sentencepiece library's without begin and end ids and without sampling; decoded is made from the ids. Null
    text counts as empty: no ids, "". Null and repeated keys pass through, a row each; other columns are not read.
    ``model`` must be readable at the same path by all executors. Narrow: no shuffle; about ``SLICE_CHARS`` of text at once,
    and a longer text by itself."""
    out = df.select(key).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")
    names = [f.name for f in out]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KnownWords(piece_model(model))
        for batch in batches:
            for at, texts in char_slices(batch.column(1), SLICE_CHARS):
                ids, ends = encode_texts(known, texts)
                decoded = [known.model.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(texts)], lists, pa.array(decoded, pa.string())], names=names)

    return df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(encoded, out)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with ``out``, the text of its ids (replaced where it is there); null ids give null, ids out of range an error."""
    kept = df.select(*[c for c in df.columns if c != out])
    schema, at = StructType([*kept.schema, StructField(out, StringType())]), kept.columns.index(ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_model(model)
        for batch in batches:
            texts = [None if i is None else known.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(decoded, schema)


def op12_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
