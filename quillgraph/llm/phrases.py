"""Phrases whose words stand together more often than chance, by sorted suffixes.

Every place of a text starts a suffix of at most ``MAX_WORDS`` words of its piece. Suffixes are counted within each slice of
texts, shuffled by language and first word and sorted in reverse order; one stack of at most ``MAX_WORDS`` counts then gives
the frequency of every prefix, that is of every phrase, in one pass over a partition. Counts of a phrase's parts are joined
afterwards.

Before that, words are counted exactly and neighbouring words by hash bucket. A suffix ends where two neighbours fall into
a bucket of fewer than ``least`` occurrences: no longer phrase can be frequent there, so nothing is lost, whatever falls
together in a bucket. Runs of three words and more whose neighbours all pass are counted by bucket likewise, and a suffix ends
before the first run that stays under ``least``: what is left of a slice is a row for each frequent phrase in it, not for each
different run of frequent pairs. A task adds up the suffixes of its slices and takes several files, so a frequent phrase leaves it
once, not once a slice. Words of a few hundredths of all suffixes are dealt out by their second word too; pairs as frequent as
that by their whole suffix, and their prefixes' counts are added up afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_bytes, table, written
from .wordhash import mix

#: Words of the longest phrase; least frequency of a phrase; phrases reported for each language.
MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Bytes of texts that are counted together before they leave a task, and of those that are taken apart into words at once.
SLICE_BYTES, TEXT_BYTES = 32 << 20, 2 << 20
#: Bytes of texts whose suffixes one task counts, slice by slice, and different suffixes that it holds before it lets them go.
TASK_BYTES, HELD = 256 << 20, 1 << 18
#: Bits of the hash of two neighbours: each filter has at most 2**28 bits, 32 MB, and 2**20 at least.
MIN_BITS, MAX_BITS = 20, 28
#: A word or pair is dealt out finer if it has more than one in so many of the words that the texts' bytes stand for.
HOT, WORD_BYTES = 256, 6

_END = b"\xff"
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] = _c + 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 0xFF


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Slice:
    """Texts of one language as one array of word numbers; 0 stands between pieces."""

    def __init__(self, lang: str):
        self.lang = lang
        self.numbers = _Numbers({_END: 0})
        self.parts: list[np.ndarray] = []
        self.waiting: list[bytes] = []

    def number(self) -> None:
        """Turns the texts that wait into numbers."""
        words = _END.join([*self.waiting, b""]).translate(bytes(_TABLE)).replace(_END, b" \xff ").split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.waiting = []

    def whole(self) -> Slice:
        self.number()
        self.ids, self.words, self.parts = np.concatenate(self.parts), list(self.numbers), []
        seed = xxhash.xxh3_64_intdigest(self.lang.encode())
        self.own = mix(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words)))
        return self

    def buckets(self, bits: int) -> np.ndarray:
        """Bucket of each place and the next as a pair, -1 where a piece ends; one less than places."""
        left, right = self.ids[:-1], self.ids[1:]
        pair = mix(self.own[left] * np.uint64(3) + self.own[right])
        return np.where((left > 0) & (right > 0), (pair >> np.uint64(64 - bits)).astype(np.int64), -1)

    def frequent(self, bucket: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Whether each place starts a pair of a frequent bucket; MAX_WORDS longer than places."""
        on = np.zeros(len(self.ids) + MAX_WORDS, bool)
        on[: len(bucket)] = (bucket >= 0) & _in(known, bucket)
        return on

    def runs(self, on: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 3 to MAX_WORDS words the places that start so many of which all neighbours are on, and the runs' buckets."""
        place = np.flatnonzero(on)
        run = self.own[self.ids[place]]
        for k in range(1, MAX_WORDS):
            stays = on[place + k - 1]
            place, run = place[stays], run[stays]
            run = mix(run * np.uint64(3) + self.own[self.ids[place + k]])
            if k > 1:
                yield place, (run >> np.uint64(64 - bits)).astype(np.int64)


def _in(known: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return known[bucket >> 3] >> (7 - (bucket & 7)) & 1 > 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Slice]:
    """Slices of the rows (lang, bytes of the text)."""
    held: dict[str, Slice] = {}
    size = waiting = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            held.setdefault(lang, Slice(lang)).waiting.append(text)
            size, waiting = size + len(text), waiting + len(text)
            if waiting >= TEXT_BYTES:
                for k in held:
                    held[k].number()
                waiting = 0
            if size >= SLICE_BYTES:
                for k in list(held):
                    yield held.pop(k).whole()
                size = 0
    for k in list(held):
        yield held.pop(k).whole()


def _rows(df: DataFrame, lang: str, text: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), as_bytes(F.col(text)).alias("text"))


def _blocks(found: np.ndarray, bits: int) -> list[pa.Array]:
    """block, places, counts of buckets."""
    width = min(16, bits - 8)
    bucket, count = np.unique(found, return_counts=True)
    block, first = np.unique(bucket >> width, return_index=True)
    cut = [*first.tolist(), len(bucket)]
    place, count = (bucket & ((1 << width) - 1)).astype("<u2"), count.astype("<u4")
    parts = [[x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)] for x in (place, count)]
    return [pa.array(block, pa.int32()), *(pa.array(p, pa.binary()) for p in parts)]


def _counted(rows: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds: lang, word, n; and block, places (uint16), counts (uint32) of the pairs' buckets."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            n = np.bincount(s.ids, minlength=len(s.words))[1:]
            some = len(n)
            if not some:
                continue
            found = s.buckets(bits)
            none = lambda k, t: pa.nulls(k, t)  # noqa: E731, B023
            words = [pa.array([s.lang] * some), pa.array(s.words[1:], pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), none(some, pa.int32()), none(some, pa.binary()), none(some, pa.binary())]
            names = ["lang", "word", "n", "block", "places", "counts"]
            yield pa.RecordBatch.from_arrays(words, names=names)
            blocks = _blocks(found[found >= 0], bits)
            k = len(blocks[0])
            yield pa.RecordBatch.from_arrays([none(k, pa.string()), none(k, pa.string()), none(k, pa.int64()), *blocks], names=names)

    return rows.mapInArrow(counted, "lang string, word string, n long, block int, places binary, counts binary")


def _counted_runs(rows: DataFrame, bits: int, frequent) -> DataFrame:
    """block, places, counts of the buckets of runs of three words and more, all lengths together."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches):
            found = [bucket for _, bucket in s.runs(s.frequent(s.buckets(bits), frequent.value), bits)]
            yield pa.RecordBatch.from_arrays(_blocks(np.concatenate(found), bits), names=["block", "places", "counts"])

    return rows.mapInArrow(counted, "block int, places binary, counts binary")


def _filter(blocks: DataFrame, bits: int, least: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits of the buckets with at least ``least`` pairs or runs, numbers of those with at least ``hot``)."""
    width = min(16, bits - 8)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, np.zeros(1 << width, np.int64)

        def done() -> pa.RecordBatch:
            hots = ((at << width) + np.flatnonzero(sums >= hot)).tolist()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary()), pa.array([hots], pa.list_(pa.int64()))], names=["block", "bits", "hot"])

        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != at:
                    if at is not None:
                        yield done()
                    at = block
                    sums[:] = 0
                sums[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u4")
        if at is not None:
            yield done()

    dealt = blocks.select("block", "places", "counts").repartition("block").sortWithinPartitions("block")
    out, hots = np.zeros(1 << (bits - 3), np.uint8), []
    size = 1 << (width - 3)
    for r in dealt.mapInArrow(summed, "block int, bits binary, hot array<long>").collect():  # at most 2**(bits - 3) bytes
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
        hots += r.hot
    return out, np.array(sorted(hots), np.int64)


def _suffixes(rows: DataFrame, bits: int, frequent, frequent_runs, hot_pairs: np.ndarray, hot_words: set[tuple[str, str]]) -> DataFrame:
    """lang, first, part, depth, suffix, n: suffixes of two words and more, counted within a task. A suffix ends each of
    its words by a space, so those that begin with the same words stand together in any order of strings. The first
    ``depth`` words decide where it goes, the whole suffix if that is over ``MAX_WORDS``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        held: dict[tuple[str, bytes], list[int]] = {}  # count, depth and part of each suffix

        def gone() -> Iterator[pa.RecordBatch]:
            some = iter(held.items())
            while rows := list(islice(some, 50_000)):
                lang, text = ([key[k] for key, _ in rows] for k in (0, 1))
                n, depth, part = ([own[k] for _, own in rows] for k in (0, 1, 2))
                first, text = (pa.array(x, pa.binary()).cast(pa.string()) for x in ([t[: t.index(b" ")] for t in text], text))
                columns = [pa.array(lang, pa.string()), first, pa.array(part, pa.int64()), pa.array(depth, pa.int32()), text, pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "first", "part", "depth", "suffix", "n"])
            held.clear()

        for s in _slices(batches):
            if len(s.ids) < 2:
                continue
            bucket = s.buckets(bits)
            on = s.frequent(bucket, known)
            place = np.flatnonzero(on)
            if not len(place):
                continue
            size = np.where(on, 2, 0).astype(np.int8)  # words of the suffix that starts here
            for k, (at, run) in enumerate(s.runs(on, bits), 3):
                at = at[_in(frequent_runs.value, run)]
                size[at[size[at] == k - 1]] = k
            wide, size = np.concatenate((s.ids, np.zeros(MAX_WORDS, np.int32))), size[place]
            column = [wide[place], *(np.where(size > k, wide[place + k], 0) for k in range(1, MAX_WORDS))]
            hot = np.isin(bucket[place], hot_pairs)
            order = np.lexsort(column[::-1])
            column, hot = [c[order] for c in column], hot[order]
            new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in column])))
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(order)))
            word = [w + b" " for w in s.words]
            word[0] = b""
            text = [b"".join(map(word.__getitem__, r)) for r in np.stack([c[first] for c in column], 1).tolist()]
            hot_first = np.isin(column[0][first], [k for k, w in enumerate(s.words) if k and (s.lang, w.decode()) in hot_words])
            depth = np.where(hot[first], MAX_WORDS + 1, np.where(hot_first, 2, 1))
            for t, m, d in zip(text, n.tolist(), depth.tolist(), strict=True):
                if (own := held.get((s.lang, t))) is not None:
                    own[0] += m
                else:
                    held[s.lang, t] = [m, d, 0 if d == 1 else xxhash.xxh3_64_intdigest(t if d > 2 else t.split(b" ", 2)[1]) >> 1]
            if len(held) >= HELD:
                yield from gone()
        yield from gone()

    return rows.mapInArrow(found, "lang string, first string, part long, depth int, suffix string, n long")


def _prefixes(suffixes: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n of all phrases of two words and more: complete and frequent, or a part of a count."""

    def popped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []
        lang, before, deep = None, None, 0
        words: list[str] = []
        stack: list[int] = []  # counts of the prefixes of ``words`` that later rows may still add to

        def shrink(size: int) -> None:
            while len(stack) > size:
                n = stack.pop()
                if len(stack) >= 1 and (n >= least or len(stack) + 1 < deep):
                    out.append((lang, " ".join(words[: len(stack) + 1]), n))
                if stack:
                    stack[-1] += n

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

        for batch in batches:
            for own, depth, suffix, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if suffix == before and own == lang:
                    stack[-1] += n
                    continue
                now = suffix[:-1].split(" ")
                same = 0
                if own == lang:
                    while same < len(words) and same < len(now) and words[same] == now[same]:
                        same += 1
                shrink(same)
                stack += [0] * (len(now) - same)
                stack[-1] += n
                lang, before, deep, words = own, suffix, depth, now
            if len(out) >= 20_000:
                yield batch_of()
        shrink(0)
        yield batch_of()

    dealt = suffixes.repartition("lang", "first", "part").sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    return dealt.select("lang", "depth", "suffix", "n").mapInArrow(popped, "lang string, phrase string, n long")


def frequencies(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n of all phrases of 1 to 5 words that occur ``least`` times or more; lang, n of all words), written.

    Null lang is ``und``, null text empty; other columns are not read. What goes through the driver is bounded: the
    filters' bits, and words and pairs that are each a few thousandths of all."""
    spark, rows = df.sparkSession, _rows(df, lang, text)
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = min(MAX_BITS, max(MIN_BITS, int(size // WORD_BYTES // 4).bit_length()))
    hot = max(least, size // WORD_BYTES // HOT)
    counted = written(_counted(rows, bits), "phrase-counts")
    words = written(counted.where("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("n")), "phrase-words")
    known, hot_pairs = _filter(counted.where("block is not null"), bits, least, hot)
    hot_words = {(r.lang, r.phrase) for r in words.where(F.col("n") >= hot).collect()}  # at most HOT * WORD_BYTES of them
    frequent = spark.sparkContext.broadcast(known)
    frequent_runs = spark.sparkContext.broadcast(_filter(_counted_runs(rows, bits, frequent), bits, least, 1 << 62)[0])
    tasks = max(-(-size // TASK_BYTES), spark.sparkContext.defaultParallelism)
    parts = _prefixes(_suffixes(rows.coalesce(tasks), bits, frequent, frequent_runs, hot_pairs, hot_words), least)
    longer = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return written(longer.unionByName(words.where(F.col("n") >= least)), "phrases"), totals


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, share: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to 5 words.

    a, l and r are the frequencies of the phrase and of its two parts at the cut with the lowest score,
    floor(1000 * a * n / (l * r)); n counts the language's words. A phrase goes if a longer one around it has ``share`` percent
    of its frequency or more: the longer by one word then has them too, so only these are looked at. Equal scores are
    ordered by a, then by phrase. Texts without a frequent phrase and empty tables give no rows."""
    known, totals = frequencies(df, lang, text, least)
    words = F.split("phrase", " ")
    phrases = known.where(F.contains("phrase", F.lit(" ")))
    cuts = phrases.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words)), " ").alias("tail")
    )
    part = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(F.broadcast(totals), "lang")  # a row a language
    scored = scored.withColumn("top", (big("a") * big("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn("bottom", (big("l") * big("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("top div bottom"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    long = phrases.where(F.size(words) > 2)
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "), F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))
    around = long.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < share * F.col("b.a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("b.score"), F.desc("b.a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
phrases AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
    FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE k > 1),
cuts AS (
    SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM candidates
),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, h.f AS l, t.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN totals n USING (lang)
    JOIN phrases h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.cut], ' ')
    JOIN phrases t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.cut + 1:], ' ')
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
    SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS f
    FROM (SELECT *, unnest(range(2, k)) AS s FROM candidates) c, (SELECT unnest(range(1, 5)) AS i) WHERE i + s - 1 <= k GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best b LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < 100 * b.a
QUALIFY rank <= 2000
"""
