"""Incremental removal of repeated passages with a log-structured index of fingerprints.

A passage repeats if a window of ``window`` words occurs in an earlier document. The index of what came before is a list
of immutable runs, each a table of (hash, document, position) bucketed and sorted by hash. A run does not hold all windows
but a selection of runs of ``gram`` words: of each ``window - gram + 1`` consecutive ones that with the smallest hash. Equal
windows select equal grams, so no repeat is missed, and there are about 2 / (window - gram + 2) of them for each word.

A new batch goes through four steps. Its selected grams become a run of their own. That run is merge-joined with each
earlier one (both are bucketed by hash: nothing of the history is shuffled) and with itself, as semi-joins, so that a gram of
many copies yields a row for each place and no pairs. Around the places found, all windows are verified by their words: the
first half of the SHA-256 of each window's words goes to the task that owns it, which tells those that come first from the
others; nothing is decided by a gram. Words under the others go. Then runs of like size are compacted into one. Documents
that repeat another one as a whole are found by the SHA-256 of all their words and leave no grams.

Hot keys are split. Grams with over ``HOT`` places in a run lie in a table of their own, which is not bucketed and whose
joins are split by the adaptive join. Of equal windows that meet in one task only the first goes on to the window's owner;
the others are known to be later there and then, so an owner gets a row for each buffer of windows, not for each copy.

The index lives in a folder: its tables, and a numbered manifest that names them, written last. ``FingerprintIndex.open``
takes it up again in another session. Runs that compaction replaced are deleted when the next manifest stands.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, flat, shared_dir, table, written
from .wordhash import WordHashes, mix, run_hashes, slices

WINDOW = 50
GRAM = 25
#: Runs of one level that are compacted into one of the next.
FAN_IN = 2
#: Places of one gram in a run from which they lie apart, unbucketed.
HOT = 10_000
#: Windows that a task compares among themselves before they go to their owners.
BUFFER = 1 << 15
#: Bits of the filter that keeps texts without candidates from being shuffled, for each candidate and at most; beyond that it
#: lets more and more texts pass, and all are shuffled in the end. No text with candidates is held back.
FILTER_BITS, FILTER_MOST = 16, 1 << 26
#: Parts in which the registered query feeds its table to the index, by doc_id.
BATCHES = 2

_ROW = np.uint64(0x9E3779B97F4A7C15)


def _selected(hashes: np.ndarray, first: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the grams that are the smallest of some window that lies within one text."""
    reach = window - gram + 1
    if len(hashes) < reach:
        return np.zeros(0, np.int64)

    def slide(values: np.ndarray, step, n: int) -> np.ndarray:
        """step over each n consecutive values, by doubling."""
        have = 1
        while have < n:
            add = min(have, n - have)
            values = step(values[: len(values) - add], values[add:])
            have += add
        return values

    least = slide(hashes, np.minimum, reach)  # of the window that starts at each word
    length = np.repeat(first[1:], np.diff(first))[: len(least)] - np.arange(len(least))
    least = np.where(length >= window, least, 0)
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)])
    most = slide(padded, np.maximum, reach)  # over the windows that hold each gram
    return np.flatnonzero((most[: len(hashes)] == hashes) & (most[: len(hashes)] > 0))


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:16], "little", signed=True)


def hashed(df: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, n_words, whole_sha256 (of all words), d1, d2 (its first two eighths), grams (different ones), at (where each stands
    first), a row per row of df(doc, text)."""
    schema = "doc long, n_words long, whole_sha256 string, d1 long, d2 long, grams array<long>, at array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            column = batch.column(1)
            for a, b in slices(flat(column)[1]):
                every = [t.split() for t in column[a:b].to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(w) for w in every])]).astype(np.int64)
                digests = [hashlib.sha256(b" ".join(w)).digest() for w in every]
                grams = run_hashes(np.concatenate([known.of(w) for w in every]), gram)
                chosen = _selected(grams, first, gram, window)
                row = np.searchsorted(first, chosen, side="right") - 1
                once = np.unique(mix(grams[chosen] + row.astype(np.uint64) * _ROW), return_index=True)[1]
                chosen = np.sort(chosen[once])  # equal grams of a text are found again from one
                edge = np.searchsorted(chosen, first)
                offsets = pa.array(edge, pa.int32())
                d1, d2 = zip(*map(_halves, digests), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(np.diff(first)),
                        pa.array([d.hex() for d in digests], pa.string()),
                        pa.array(d1, pa.int64()),
                        pa.array(d2, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(grams[chosen].view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array((chosen - np.repeat(first[:-1], np.diff(edge))).astype(np.int32))),
                    ],
                    names=["doc", "n_words", "whole_sha256", "d1", "d2", "grams", "at"],
                )

    return df.select("doc", as_bytes(F.col("text")).alias("text")).mapInArrow(work, schema)


def _digests(words: list[bytes], joined: bytes, pos: np.ndarray, window: int) -> np.ndarray:
    """Two signed 64-bit numbers for the words of each window, from the SHA-256 of them joined by one space."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    raw, sha = memoryview(joined), hashlib.sha256
    out = b"".join([sha(raw[a:b]).digest()[:16] for a, b in zip(starts[pos].tolist(), ends[pos + window - 1].tolist(), strict=True)])
    return np.frombuffer(out, "<i8").reshape(-1, 2)


_WINDOWS = "w1 long, w2 long, new boolean, doc long, d1 long, pos int, later boolean"


def _windows(df: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each different window of a text that holds one of the places: w1, w2 (of its words), new, doc, d1, pos (where
    the first of equal ones starts), later. later says that an earlier document with this window was met in this task;
    of old windows only such a task's first are given. df: doc, d1, new, places, text."""

    def settled(rows: list[np.ndarray]) -> pa.RecordBatch:
        w1, w2, new, doc, d1, pos = np.concatenate(rows).T
        order = np.lexsort((doc, new, w2, w1))
        w1, w2, new, doc, d1, pos = (x[order] for x in (w1, w2, new, doc, d1, pos))
        turn = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        owner = np.maximum.accumulate(np.where(turn, np.arange(len(w1)), 0))
        later = (new == 1) & ((new[owner] == 0) | (doc > doc[owner]))
        kept = (new == 1) | turn
        columns = [w1, w2, new == 1, doc, d1, pos.astype(np.int32), later]
        return pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in columns], names=["w1", "w2", "new", "doc", "d1", "pos", "later"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows, n = WordHashes(), [], 0
        for batch in batches:
            for doc, d1, new, places, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4), strict=True):
                words = text.as_py().split()
                last = len(words) - window
                joined = b" ".join(words)
                if last < 0 or _halves(hashlib.sha256(joined).digest())[0] != d1:  # a key may stand for several texts
                    continue
                own = run_hashes(known.of(words), gram)
                p = np.flatnonzero(np.isin(own, own[np.asarray(places.values)]))
                marks = np.zeros(len(words) + 1, np.int32)
                np.add.at(marks, np.maximum(p - (window - gram), 0), 1)
                np.add.at(marks, np.minimum(p, last) + 1, -1)
                pos = np.flatnonzero(np.cumsum(marks) > 0)
                for a in range(0, len(pos), BUFFER):
                    some = pos[a : a + BUFFER]
                    w = _digests(words, joined, some, window)
                    order = np.lexsort((some, w[:, 1], w[:, 0]))  # words said over and over give one window many times
                    w = w[order]
                    once = np.concatenate([[True], (w[1:] != w[:-1]).any(axis=1)])
                    w, some = w[once], some[order][once]
                    rows.append(np.column_stack([w, np.full(len(w), int(new)), np.full(len(w), doc), np.full(len(w), d1), some]))
                    n += len(w)
                    if n >= BUFFER:
                        yield settled(rows)
                        rows, n = [], 0
        if rows:
            yield settled(rows)

    return df.select("doc", "d1", "new", "places", "text").mapInArrow(work, _WINDOWS)


def _later(windows: DataFrame) -> DataFrame:
    """doc, d1, pos of the new windows that an earlier document has: one pass over sorted rows, with one row of memory.

    Rows that are known to be later are dealt by document and passed on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # w1, w2, new, doc of the first row of the window that may go on
        for batch in batches:
            sure = batch.column(6).to_numpy(zero_copy_only=False)
            if sure.any():
                passed = pa.array(np.flatnonzero(sure))
                yield pa.RecordBatch.from_arrays([batch.column(k).take(passed) for k in (3, 4, 5)], names=["doc", "d1", "pos"])
                batch = batch.filter(pa.array(~sure))
            if not batch.num_rows:
                continue
            w1, w2, new, doc = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            turn = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
            if held is not None and (held[0], held[1]) == (w1[0], w2[0]):
                turn[0] = False
            owner = np.maximum.accumulate(np.where(turn, np.arange(len(w1)), -1))
            start = max(0, int(np.argmax(owner >= 0))) if (owner >= 0).any() else len(w1)
            own_new, own_doc = new[owner], doc[owner]
            if start:
                own_new[:start], own_doc[:start] = held[2], held[3]
            later = np.flatnonzero(new.astype(bool) & (~own_new.astype(bool) | (doc > own_doc)))
            if len(later):
                took = pa.array(later)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(took) for k in (3, 4, 5)], names=["doc", "d1", "pos"])
            held = (w1[-1], w2[-1], own_new[-1], own_doc[-1])

    to1, to2 = F.when(F.col("later"), F.xxhash64("doc", "pos")).otherwise(F.col("w1")), F.when(~F.col("later"), F.col("w2"))
    rows = windows.withColumns({"to1": to1, "to2": to2}).repartition("to1", "to2").drop("to1", "to2")
    return rows.sortWithinPartitions("w1", "w2", "new", "doc").mapInArrow(scan, "doc long, d1 long, pos int")


def _covered(words: list[bytes], hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each word lies under a window at one of the starts, or one with the same words elsewhere in the text."""
    at = np.flatnonzero(np.isin(hashes, hashes[starts]))
    if len(at) > len(starts):
        by: dict[int, list[int]] = {}
        for s in starts.tolist():
            by.setdefault(int(hashes[s]), []).append(s)
        given = set(starts.tolist())
        same = lambda p: any(words[p : p + window] == words[s : s + window] for s in by[int(hashes[p])])
        at = np.array([p for p in at.tolist() if p in given or same(p)], np.int64)
    marks = np.zeros(len(words) + window + 1, np.int32)
    marks[at] += 1
    marks[at + window] -= 1
    return np.cumsum(marks)[: len(words)] > 0


def _kept(df: DataFrame, window: int) -> DataFrame:
    """doc, d1, n_removed, kept_text of df(doc, d1, starts, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            removed, kept, right = [], [], []
            for d1, starts, text in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                words = text.as_py().split()
                right.append(_halves(hashlib.sha256(b" ".join(words)).digest())[0] == d1)
                if not right[-1]:  # another text of the same key
                    removed.append(0)
                    kept.append("")
                    continue
                gone = _covered(words, run_hashes(known.of(words), window), np.unique(np.asarray(starts.values)), window)
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc", "d1", "n_removed", "kept_text"])
            yield out.filter(pa.array(right, pa.bool_()))

    return df.select("doc", "d1", "starts", "text").mapInArrow(work, "doc long, d1 long, n_removed long, kept_text string")


@dataclass
class Run:
    """Names of a run's tables: places of grams (gram, doc, d1, pos), those of its hot grams (unbucketed, empty name if there
    are none), and d1, d2 of its documents that are no copies."""

    level: int
    places: str
    hot: str
    wholes: str


_PLACES, _WHOLES = "gram BIGINT, doc BIGINT, d1 BIGINT, pos INT", "d1 BIGINT, d2 BIGINT"


class FingerprintIndex:
    """Runs of selected grams and of whole documents' hashes, in one folder of the shared ones.

    ``add`` takes a batch, judges it against itself and all earlier ones, and makes it part of the index. Batches count as
    later than what is indexed, whatever their keys are; inside a batch a smaller key comes first."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, path: str | None = None, hot: int = HOT):
        if not 0 < gram <= window:
            raise ValueError("a gram has between one and all words of a window")
        self.spark, self.window, self.gram, self.hot = spark, window, gram, hot
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{shared_dir(spark)}/quillgraph/index-{uuid.uuid4().hex}"
        self.runs: list[Run] = []
        self.version = 0
        self._replaced: list[Run] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index as its newest manifest has it."""
        found = spark.read.text(f"{path}/manifest-*").select("value", F.regexp_extract(F.col("_metadata.file_path"), r"manifest-(\d+)/", 1).cast("int").alias("n"))
        last = found.orderBy(F.desc("n")).first()  # one row for each manifest
        kept = json.loads(last.value)
        index = cls(spark, kept["window"], kept["gram"], kept["buckets"], path, kept["hot"])
        index.version, index.runs = last.n, [Run(**r) for r in kept["runs"]]
        for run in index.runs:
            index._named(run.places, _PLACES, "gram")
            index._named(run.wholes, _WHOLES, "d1")
        return index

    def _named(self, name: str, columns: str, by: str) -> None:
        where = f"{self.path}/{name}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{where}'")

    def _bucketed(self, rows: DataFrame, kind: str, by: str) -> str:
        name = f"{kind}_{uuid.uuid4().hex}"
        ordered = rows.repartition(self.buckets, by).sortWithinPartitions(by)
        ordered.write.bucketBy(self.buckets, by).sortBy(by).option("compression", "zstd").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _run(self, level: int, grams: DataFrame, wholes: DataFrame) -> tuple[Run, DataFrame]:
        """A run, and gram, shared of its different grams; counts are combined before they are shuffled."""
        counted = written(grams.groupBy("gram").agg(F.count("*").alias("n"), (F.min("doc") < F.max("doc")).alias("shared")).where("n > 1"), "grams")
        often = counted.where(F.col("n") > self.hot).select("gram")
        hot, few = "", grams
        if not often.isEmpty():
            hot, few = f"hot_{uuid.uuid4().hex}", grams.join(often, "gram", "left_anti")
            grams.join(often, "gram", "left_semi").write.option("compression", "zstd").parquet(f"{self.path}/{hot}")
        run = Run(level, self._bucketed(few, "grams", "gram"), hot, self._bucketed(wholes, "wholes", "d1"))
        return run, counted.where("shared").select("gram")

    def _places(self, run: Run) -> list[DataFrame]:
        return [self.spark.table(run.places), *([self.spark.read.schema(_PLACES).parquet(f"{self.path}/{run.hot}")] if run.hot else [])]

    def _compact(self) -> None:
        while len(same := [r for r in self.runs if r.level == self.runs[-1].level]) >= FAN_IN:
            both = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(both(frames[1:]))
            merged, _ = self._run(same[0].level + 1, both([p for r in same for p in self._places(r)]), both([self.spark.table(r.wholes) for r in same]))
            self.runs = [r for r in self.runs if r not in same] + [merged]
            self._replaced += same

    def _saved(self) -> None:
        """Writes the manifest, then deletes what it no longer names."""
        self.version += 1
        kept = {"window": self.window, "gram": self.gram, "buckets": self.buckets, "hot": self.hot, "runs": [vars(r) for r in self.runs]}
        self.spark.createDataFrame([(json.dumps(kept),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version}")
        jvm = self.spark._jvm
        for run in self._replaced:
            for name in filter(None, (run.places, run.hot, run.wholes)):
                where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._replaced = []

    def _filtered(self, texts: DataFrame, places: DataFrame) -> DataFrame:
        """Rows of texts whose doc may be among the places; the filter has a fixed number of bits at most."""
        n = places.count()
        bits = min(FILTER_MOST, 1 << max(12, (FILTER_BITS * n - 1).bit_length()))
        bit = F.pmod(F.xxhash64("doc"), F.lit(bits))
        words = places.select(bit.alias("b")).groupBy((F.col("b") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("set")).toPandas()
        filled = np.zeros(bits // 32, np.int64)
        filled[words["word"].to_numpy(dtype=np.int64)] = words["set"].to_numpy(dtype=np.int64)
        shared = self.spark.sparkContext.broadcast(filled)

        def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b = batch.column(2).to_numpy(zero_copy_only=False)
                keep = (shared.value[b // 32] >> (b % 32)) & 1 == 1
                yield batch.select([0, 1]).filter(pa.array(keep))

        return texts.where("doc is not null").select("doc", as_bytes(F.col("text")).alias("text"), bit.alias("b")).mapInArrow(passed, "doc long, text binary")

    def add(self, batch: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
        """One row per row of batch: key, n_words, n_removed, kept_sha256 (of kept words joined by one space), and
        kept_text if asked for (null where nothing goes).

        texts: batch and all earlier batches (or their union's table); only texts with candidates are read on from it.
        Null text has no words. A row with a null key keeps all words and takes none away from others; rows that share a
        key count as one document, and none of their words goes on account of the others. Keys must be whole numbers."""
        window, gram = self.window, self.gram
        batch = batch.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        texts = texts.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
        docs = written(hashed(batch, window, gram), "hashed")

        known = docs.where("doc is not null").groupBy("d1", "d2").agg(F.min("doc").alias("least"))
        known = known.withColumn("old", F.lit(False))
        for run in self.runs:
            known = known.join(self.spark.table(run.wholes).withColumn("hit", F.lit(True)), ["d1", "d2"], "left").withColumn("old", F.col("old") | F.coalesce("hit", F.lit(False))).drop("hit")
        known = written(known, "wholes")
        firsts = known.where("not old").select("d1", "d2")
        copy = F.coalesce(F.col("old") | (F.col("doc") > F.col("least")), F.lit(False))
        # copies of one text are many rows of one key: a join of two written tables, which the adaptive join splits
        docs = written(docs.join(known, ["d1", "d2"], "left").withColumn("copy", copy).drop("old", "least"), "docs")

        grams = docs.where("not copy and doc is not null").select("doc", "d1", F.explode(F.arrays_zip("grams", "at")).alias("g")).select(F.col("g.grams").alias("gram"), "doc", "d1", F.col("g.at").alias("pos"))
        run, repeated = self._run(0, grams, firsts)
        mine, places = self._places(run), []
        for earlier in self.runs:
            for old in self._places(earlier):
                for new in mine:
                    met = old.join(new.select("gram").distinct(), "gram", "left_semi")  # a gram of a third of all documents is one row
                    places.append(met.withColumn("new", F.lit(False)))
                    repeated = repeated.unionByName(met.select("gram").distinct())
        repeated = repeated.distinct()
        places += [new.join(repeated, "gram", "left_semi").withColumn("new", F.lit(True)) for new in mine]
        found = places[0]
        for more in places[1:]:
            found = found.unionByName(more)
        places = written(found.groupBy("doc", "d1", "new").agg(F.array_distinct(F.collect_list("pos")).alias("places")), "places")

        candidates = written(self._filtered(texts, places).join(places, "doc"), "candidates")
        later = _later(_windows(candidates, window, gram))
        starts = later.groupBy("doc", "d1").agg(F.collect_set("pos").alias("starts"))
        cut = _kept(candidates.where("new").select("doc", "d1", "text").join(starts, ["doc", "d1"]), window)
        sha = F.sha2("kept_text", 256).alias("cut_sha")
        cut = cut.select("doc", "d1", "n_removed", sha, *(["kept_text"] if with_text else [])).dropDuplicates(["doc", "d1"])

        gone = F.col("copy") & (F.col("n_words") >= window)
        judged = docs.select("doc", "d1", "n_words", "whole_sha256", "copy").join(cut, ["doc", "d1"], "left")
        judged = judged.select(
            F.col("doc").alias(key),
            "n_words",
            F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "whole_sha256")).alias("kept_sha256"),
            *([F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
        )
        self.runs.append(run)
        self._compact()
        self._saved()
        return judged


def repeated_passages(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """All rows of df judged in ``batches`` ranges of the key, smallest first; see ``FingerprintIndex.add``."""
    index = FingerprintIndex(df.sparkSession, window, gram, hot=hot)
    low, high = df.agg(F.min(key), F.max(key)).first()
    edges = [low + (high - low + 1) * k // batches for k in range(1, batches)] if low is not None else []
    out = None
    for k, (a, b) in enumerate(zip([None, *edges], [*edges, None], strict=True)):
        part = df if a is None else df.where(F.col(key) >= a)
        part = part if b is None else part.where(F.coalesce(F.col(key) < b, F.lit(k == 0)))
        part = part if k == 0 or b is not None else part.where(F.col(key).isNotNull())
        up_to = df if b is None else df.where(F.col(key) < b)
        judged = index.add(part, up_to, key, text, with_text)
        out = judged if out is None else out.unionByName(judged)
    return out


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
