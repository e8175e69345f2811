"""Dictionary matching with more keywords than a plan should hold as a literal: the dictionary is a table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.held import written
from . import automaton

#: Cells of an automaton (nodes by different bytes), four bytes each: a larger dictionary is searched for in shards.
CELLS = 1 << 24
#: Bytes of texts that are searched at once; a text that alone has more is a slice of its own.
SLICE = 4 << 20


@lru_cache(maxsize=1)  # a worker keeps its last one
def _built(words: tuple[str, ...]) -> automaton.Automaton:
    return automaton.build(words)


def _parts(entries: DataFrame, cells: int) -> int:
    """Shards, so that the words of one, dealt by hash, have about as many bytes as fit the cells."""
    each = F.explode(F.array_distinct(F.regexp_extract_all(F.hex(F.encode("word", "utf-8")), F.lit("(..)"), F.lit(1))))
    total = entries.select("word").distinct().agg(F.sum(F.octet_length("word"))).first()[0] or 0
    used = entries.select(each.alias("byte")).distinct().count()  # 243 at most
    return -(-total * (used + 1) // cells)


def _slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows with at most so many bytes, or of one row."""
    out, first, held = [], 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and held + size > most:
            out.append((first, k))
            first, held = k, 0
        held += size
    return [*out, (first, len(sizes))] if len(sizes) > first else out


def _searched(rows: DataFrame, entries: list[tuple[str, str]], schema: StructType) -> DataFrame:
    """key, name of the entries whose word stands in the body, with repeats. Narrow: no text is moved."""
    words = tuple(sorted({w for _, w in entries}))
    number = {w: k for k, w in enumerate(words)}
    pairs = sorted(((number[w], n) for n, w in entries), key=lambda p: p[0])  # names may be null
    held = rows.sparkSession.sparkContext.broadcast((words, [n for _, n in pairs], np.searchsorted([w for w, _ in pairs], np.arange(len(words) + 1))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names, starts = held.value
        of = _built(words)
        for batch in batches:
            body = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2] or b"", np.uint8)
            for a, b in _slices(np.diff(ends), SLICE):
                row, word = automaton.found(of, data, ends[a : b + 1])
                many = starts[word + 1] - starts[word]
                which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[word], many)
                keys = batch.column(0).take(pa.array(np.repeat(row + a, many)))
                yield from pa.Table.from_arrays([keys, pa.array([names[k] for k in which.tolist()], pa.string())], names=schema.names).to_batches()

    return rows.mapInArrow(search, schema)


def matched(docs: DataFrame, words: DataFrame, key: str = "doc_id", body: str = "text", cells: int = CELLS) -> DataFrame:
    """key, name of the entries of which a keyword stands in the text, each once for each key; null text has none.

    words: name, word, a row for each keyword; empty and null ones match nothing, null keys and names stay as they are. The
    dictionary is measured and dealt into shards by hash; each is an automaton of about ``cells`` cells (64 MB), sent to the
    workers as its words (a byte for each node at most) and built there, and the texts are read once for each shard. Only
    what was found is shuffled."""
    entries = words.where("word <> ''").select(F.col("name").cast("string").alias("name"), F.col("word").cast("string").alias("word")).distinct()
    entries = written(entries, "keywords")
    parts = _parts(entries, cells)
    rows = docs.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body")).where("body is not null")
    schema = StructType([rows.schema["key"]]).add("name", "string")
    own = lambda k: [tuple(r) for r in entries.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k).collect()]  # noqa: E731  # a shard
    shards = [_searched(rows, found, schema) for k in range(parts) if (found := own(k))]
    if not shards:
        return rows.select(F.col("key").alias(key), F.lit("").alias("name")).where("false")
    return reduce(DataFrame.union, shards).distinct().select(F.col("key").alias(key), "name")
