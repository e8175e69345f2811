"""Benchmark decontamination as a prefix-filtered set join of document words with benchmark windows.

A window is ``window`` consecutive words of an item (all words of a shorter one). As a set it is its positioned shingles of
up to three words, and a document holds it only if it holds all of them: with a containment of one, a prefix of one shingle
is necessary. Shingles are ordered by rarity, counted over all documents, so each window is looked for by the one that the
fewest documents' words give. A place where that shingle stands fixes where the window would start; the positional bound
is that this is not before the document, the length bound that it ends inside, and then all its words are compared.

The prefix table is broadcast only up to a fixed number of bytes. Beyond it the same join runs as a shuffle on the shingle, to
which only places go whose shingle a Bloom filter of the prefixes holds. The filter's size is bounded; where it is full, more
places are shuffled and the join drops them, so rows are the same.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import as_bytes, table, unused, written

WINDOW = 10
#: Words of a shingle at most.
SHINGLE = 3
#: Bytes of windows up to which they and their prefixes are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bits of a Bloom filter for each shingle at least, bits of one at most (32 MB, which go through the driver), bits that a shingle sets.
BITS_EACH, FILTER_BITS, HASHES = 16, 1 << 28, 3

# a byte of words as it is, or lower-cased; all others become spaces
_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def shingles_of(words: list[bytes], n: int) -> Iterator[bytes]:
    """Runs of n words, joined by spaces."""
    if n == 1:
        return iter(words)
    return map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))


def windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """item (as a string), words (joined by spaces), n, size (of its shingles): each different window of each item.

    Items without words have none; null text has no words. Rows that repeat an item add their windows to it. Null items
    are left out: nothing could name them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(raw)
                n = min(window, len(words))
                if not n:
                    continue
                own = list(dict.fromkeys(b" ".join(words[k : k + n]).decode() for k in range(len(words) - n + 1)))
                columns = [pa.array([item_id] * len(own), pa.string()), pa.array(own), pa.array([n] * len(own), pa.int32()), pa.array([min(n, SHINGLE)] * len(own), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "words", "n", "size"])

    source = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), as_bytes(F.col(text)).alias("text"))
    return source.mapInArrow(cut, "item string, words string, n int, size int")


def _positioned(found: DataFrame) -> DataFrame:
    """Adds a row for each positioned shingle of a window: shingle, offset."""
    words = F.split("words", " ")
    shingle = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda k: F.struct(F.array_join(F.slice(words, k + 1, F.col("size")), " ").alias("shingle"), k.alias("offset")))
    return found.withColumn("s", F.explode(shingle)).select("*", "s.shingle", "s.offset").drop("s")


def positions(shingles: list[bytes], bits: int) -> np.ndarray:
    """The bits that shingles set in a filter of so many, a power of two: a row for each of HASHES."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles))
    turns = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((h + turns * (h >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def bloom(shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of the one column of shingles, as words of 64 bits. Its bits are set in tasks and united by an aggregate."""
    own = shingles.distinct()
    bits = min(FILTER_BITS, 1 << max(10, (BITS_EACH * own.count() - 1).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(batch.column(0).to_pylist(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "bits"])

    rows = own.mapInArrow(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return held


def may_hold(held: np.ndarray, shingles: list[bytes]) -> np.ndarray:
    """Whether the filter has each of the shingles: true for all of its own, and for few others."""
    at = positions(shingles, len(held) << 6)
    return (held[at >> 6] >> (at & 63) & 1).astype(bool).all(0)


def _emitted(texts: DataFrame, wanted, sizes: list[int]) -> DataFrame:
    """shingle, n: how often each stands in texts, summed for each task. wanted: a broadcast set, or a broadcast filter, which lets
    a few others pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0):
                words = words_of(raw.as_py())
                for size in sizes:
                    if isinstance(wanted.value, frozenset):
                        seen.update(filter(wanted.value.__contains__, shingles_of(words, size)))
                    else:
                        for _, own, at in _sliced(words, size, wanted.value):
                            seen.update(own[k] for k in at)
                if len(seen) > 200_000:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    return texts.mapInArrow(count, "shingle binary, n long")


def _sliced(words: list[bytes], size: int, held: np.ndarray, slice_: int = 2_000) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(start, shingles, those that the filter may hold) of slices of a text's words."""
    for a in range(0, len(words), slice_):
        if own := list(shingles_of(words[a : a + slice_ + size - 1], size)):
            yield a, own, np.flatnonzero(may_hold(held, own)).tolist()


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["shingle", "n"])


def _covered(starts: list[tuple[int, int]]) -> int:
    """Words in the union of (start, length) spans."""
    total = reach = 0
    for s, n in sorted(starts):
        total += max(0, s + n - max(s, reach))
        reach = max(reach, s + n)
    return total


def _items(found: set[str]) -> tuple[int, str]:
    return len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs: key, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are runs of digits, letters and all characters beyond ASCII, with A to Z in lower case; null text has none. A
    word is hit if it lies in an occurrence of a window. Null and repeated keys pass through, a row each. With an empty
    benchmark nothing is hit."""
    bench = written(windows(benchmark, window, item, item_text), "windows")
    sizes, size_bytes = bench.agg(F.collect_set("size"), F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item") + 64), F.lit(0))).first()
    sizes = sorted(sizes)
    bounded = size_bytes <= broadcast_bytes
    whole = docs.select(as_bytes(F.col(text)).alias("text"))

    positioned = _positioned(bench)
    own = positioned.select(F.col("shingle").cast("binary"))
    held = frozenset(own.distinct().toArrow().column(0).to_pylist()) if bounded else bloom(own)
    vocabulary = docs.sparkSession.sparkContext.broadcast(held)
    rarity = _emitted(whole, vocabulary, sizes).groupBy("shingle").agg(F.sum("n").alias("n_docs_words"))
    counted = positioned.withColumn("shingle", F.col("shingle").cast("binary")).join(rarity, "shingle", "left")
    order = F.struct(F.coalesce("n_docs_words", F.lit(0)).alias("rarity"), "shingle", "offset")
    prefix = counted.groupBy("item", "words", "n", "size").agg(F.min(order).alias("p"))
    # a shingle that no document has leads nowhere
    prefix = written(prefix.where("p.rarity > 0").select("item", "words", "n", "size", "p.shingle", "p.offset"), "prefixes")
    if bounded:
        return _probed(docs, prefix, key, text, sizes)
    return _shuffled(docs, prefix, key, text, sizes)


def _result(key: str, docs: DataFrame) -> StructType:
    return StructType([docs.schema[key]]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")


def _probed(docs: DataFrame, prefix: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """The join inside each task, against the broadcast prefix table."""
    schema = _result(key, docs)
    index: dict[bytes, dict[tuple[bytes, int], list[str]]] = defaultdict(lambda: defaultdict(list))
    rows = prefix.toArrow().to_pydict()
    for own, words, shingle, offset in zip(rows["item"], rows["words"], rows["shingle"], rows["offset"], strict=True):
        index[shingle][words.encode(), offset].append(own)
    packed = {s: [(w.split(b" "), o, items) for (w, o), items in own.items()] for s, own in index.items()}
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out = []
            for raw in batch.column(1):
                words = words_of(raw.as_py())
                spans: dict[int, int] = {}
                items: set[str] = set()
                for size in sizes:
                    at = [k for k, s in enumerate(shingles_of(words, size)) if s in index]
                    for k in at:
                        for want, offset, own in index[words[k] if size == 1 else b" ".join(words[k : k + size])]:
                            start = k - offset
                            if start >= 0 and start + len(want) <= len(words) and words[start : start + len(want)] == want:
                                spans[start] = max(spans.get(start, 0), len(want))
                                items.update(own)
                out.append((len(words), _covered(list(spans.items())), *_items(items)))
            n, hit, n_items, sha = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, hit, n_items)), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(key), as_bytes(F.col(text)).alias("text")).mapInArrow(probe, schema)


def _shuffled(docs: DataFrame, prefix: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """The join by shuffle: document shingles that may be prefixes, with their surroundings, against prefixes.

    A frequent shingle's rows are salted; the prefix table, of at most one row for each window, is repeated for each salt."""
    schema, salts = _result(key, docs), 16
    numbered = written(docs.select(F.col(key).alias("key"), as_bytes(F.col(text)).alias("text"), F.expr("uuid()").alias("row")), "rows")
    reach = prefix.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    shared = docs.sparkSession.sparkContext.broadcast(bloom(prefix.select("shingle")))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(raw)
                for size in sizes:
                    for a, own, at in _sliced(words, size, shared.value):
                        if at:
                            k = [a + x for x in at]
                            near = [max(0, x - reach) for x in k]
                            some = [b" ".join(words[f : x + reach]).decode() for f, x in zip(near, k, strict=True)]
                            columns = [pa.array([row] * len(at)), pa.array([own[x] for x in at], pa.binary()), pa.array(k, pa.int32()), pa.array(near, pa.int32()), pa.array(some)]
                            yield pa.RecordBatch.from_arrays(columns, names=["row", "shingle", "k", "from", "near"])

    stands = numbered.select("row", "text").mapInArrow(places, "row string, shingle binary, k int, from int, near string")
    salted = prefix.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    pairs = stands.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(salted, ["shingle", "salt"])
    start = F.col("k") - F.col("offset")
    bounded = pairs.withColumn("start", start).where("start >= 0")
    near = F.slice(F.split("near", " "), F.col("start") - F.col("from") + 1, F.col("n"))
    hits = bounded.where(F.array_join(near, " ") == F.col("words")).select("row", "start", "n", "item")
    spans = hits.groupBy("row").agg(F.collect_set(F.struct("start", "n")).alias("spans"), F.collect_set("item").alias("items"))
    both = numbered.join(spans, "row", "left")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, spans, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                out.append((len(words_of(raw)), _covered([(s["start"], s["n"]) for s in spans or []]), *_items(set(items or []))))
            n, hit, n_items, sha = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column(0).cast(kind), *(pa.array(x, pa.int64()) for x in (n, hit, n_items)), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    kind = to_arrow_type(docs.schema[key].dataType)
    return both.select("key", "text", "spans", "items").mapInArrow(closed, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs. Of rows that share a key all go
    if one does; rows with a null key all stay."""
    mark = unused("key", docs)
    found = contamination(docs, benchmark, key, **how).where("contaminated").select(F.col(key).alias(mark)).distinct()
    return docs.join(found, docs[key] == found[mark], "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM bn, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS u(k)),
     sizes AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT doc_id, k, s.n, array_to_string(w[k : k + s.n - 1], ' ') AS win FROM d, sizes s, unnest(range(1, CAST(len(w) - s.n + 2 AS BIGINT))) AS u(k)),
     hits AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw USING (n, win)),
     pos AS (SELECT DISTINCT doc_id, p FROM hits, unnest(range(k, k + n)) AS u(p)),
     nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
     it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
