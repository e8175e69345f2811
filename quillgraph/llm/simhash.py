"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 64 bits, read as 8 bytes. If two fingerprints differ in at most d < 8 bits, they share at least m = 8 - d of
their positional bytes, so the tally of a pair's shared positional bytes must reach m; then the differing bits are counted.

Posting lists of single bytes hold a 256th of the corpus each, and tallying over them meets almost every pair. So the index is
prefix-filtered: positional bytes are ordered by the length of their lists, and two fingerprints that share m of 8 must share
two of the 8 - m + 2 rarest of each. One posting is kept for each two of these (15 for d = 4), and the tally is taken for the
fingerprints that meet in a list.

No list is expanded into its pairs. What is wanted is which fingerprints reach each other, so a list yields a spanning
forest: fingerprints are taken up as balls of radius d around pivots, and two balls are compared only while they are not
joined and their pivots are near enough for a link to exist. Lists longer than ``list_size`` are dealt anew by further bytes
that linked fingerprints must share, then by half-bytes (for each choice that a linked pair must share), after which at most
16 bits are open, so that no list, however many copies there are, holds more than 65,536 different fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_bytes, table, unused, written
from .components import components

#: Bits in which linked fingerprints may differ.
MAX_BITS = 4
#: Words of a shingle.
SHINGLE = 4
#: A longer posting list is dealt anew by finer keys; a shorter one is compared pair by pair, with many others at once.
LIST_SIZE, SMALL = 8_000, 48
#: Positional bytes of which a posting is made.
KEY = 2
#: Fingerprints from which postings are made at once.
BLOCK = 4_096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` lower-cased words, joined by single spaces; of all words if there are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(size) - 1
    k = min(shingle, len(words))
    starts = (ends - size + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The bits that are set in over half of the hashes; zero without words."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65_536):
        votes += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """key, fp long (the fingerprint's bits as a signed number), a row per input row. Null text counts as empty: zero."""
    schema = StructType([df.schema[key]]).add("fp", "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return df.select(F.col(key), as_bytes(F.col(text)).alias("text")).mapInArrow(hashed, schema)


# ---- postings


def _finer(mask: int, max_bits: int) -> list[int]:
    """Masks that add to ``mask`` what two fingerprints that agree under it must share besides, for each choice: whole bytes
    as long as there are fewer than they must share, then half-bytes."""
    have = sum(mask >> 8 * p & 0xFF == 0xFF for p in range(8))
    if have < 8 - max_bits:
        open_ = [p for p in range(8) if not mask >> 8 * p & 0xFF]
        return [mask | sum(0xFF << 8 * p for p in chosen) for chosen in combinations(open_, 8 - max_bits - have)]
    open_ = [h for h in range(16) if not mask >> 4 * h & 0xF]
    shared = max(0, len(open_) - max_bits)
    return [mask | sum(0xF << 4 * h for h in chosen) for chosen in combinations(open_, shared)]


def byte_ranks(fps: DataFrame) -> np.ndarray:
    """Rank of each of the 8 x 256 positional bytes by how many fingerprints have it, the rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((8, 256), np.int64)
        for batch in batches:
            own = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
            for p in range(8):
                n[p] += np.bincount(own[:, p], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2048, dtype=np.int32)), pa.array(n.ravel())], names=["at", "n"])

    total = np.zeros(2048, np.int64)
    for r in fps.select("fp").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # 2,048 rows
        total[r.at] = r.n
    ranks = np.empty(2048, np.int64)
    ranks[np.argsort(total, kind="stable")] = np.arange(2048)
    return ranks.reshape(8, 256)


def postings(fps: DataFrame, max_bits: int) -> DataFrame:
    """part (hash of the positional bytes), mask, fp: each different fingerprint under each pair of its rarest bytes."""
    key = min(KEY, 8 - max_bits)
    prefix, ranks = max_bits + key, byte_ranks(fps)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for a in range(0, len(every), BLOCK):
                fp = every[a : a + BLOCK]
                order = np.argsort(ranks[np.arange(8), fp.view(np.uint8).reshape(-1, 8)], axis=1)[:, :prefix].astype(np.uint64)
                byte = np.uint64(0xFF) << np.uint64(8) * order
                for chosen in combinations(range(prefix), key):
                    yield _posted(np.bitwise_or.reduce(byte[:, chosen], axis=1), fp)

    return fps.select("fp").mapInArrow(listed, "part long, mask long, fp long")


def _posted(mask: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    """Different lists may get one part; the mask and the masked fingerprint tell them apart."""
    mixed = ((fp & mask) + mask * np.uint64(0xD6E8FEB86659FD93)) * _MIX
    mixed ^= mixed >> np.uint64(32)
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mixed * _MIX, mask, fp)], names=["part", "mask", "fp"])


def _redealt(lists: DataFrame, max_bits: int) -> DataFrame:
    """The rows of long lists under finer masks."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, mask = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1))
            for own in np.unique(mask):
                some = fp[mask == own]
                for finer in _finer(int(own), max_bits):
                    for a in range(0, len(some), BLOCK):
                        yield _posted(np.full(len(some[a : a + BLOCK]), finer, np.uint64), some[a : a + BLOCK])

    return lists.select("fp", "mask").mapInArrow(listed, "part long, mask long, fp long")


# ---- links inside lists


def tallies(diff: np.ndarray) -> np.ndarray:
    """How many positional bytes are shared, of the differences of fingerprints."""
    spread = diff | diff >> np.uint64(4)
    spread |= spread >> np.uint64(2)
    spread |= spread >> np.uint64(1)
    return 8 - np.bitwise_count(spread & np.uint64(0x0101010101010101))


def linked(x: np.ndarray, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether pairs reach the tally that is guaranteed for links, and differ in few enough bits."""
    diff = x ^ y
    out = tallies(diff) >= 8 - max_bits
    out[out] = np.bitwise_count(diff[out]) <= max_bits
    return out


class Forest:
    """Joined sets of small numbers."""

    def __init__(self):
        self.top: dict[int, int] = {}

    def root(self, k: int) -> int:
        top = self.top
        while (up := top.setdefault(k, k)) != k:
            top[k] = k = top[up]
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether they were not joined before."""
        a, b = self.root(a), self.root(b)
        self.top[a] = b
        return a != b


def spanning_links(fp: np.ndarray, near, far) -> tuple[list[tuple[int, int]], list[int]]:
    """Pairs of indices that connect what is connected by links among different fingerprints, and the pivots of the balls.

    near(x, y): whether rows are linked. far(x, y): whether members of balls around them may be. A ball holds what is linked
    to its pivot and lies in no earlier ball; a link between members of two balls matters only while these are not joined."""
    links: list[tuple[int, int]] = []
    rest, balls, forest = np.arange(len(fp)), [], Forest()
    while len(rest):
        own = near(fp[rest], fp[rest[0]])
        own[0] = True
        ball, rest = rest[own], rest[~own]
        links += [(int(ball[0]), int(k)) for k in ball[1:]]
        me = len(balls)
        if balls:
            for other in np.flatnonzero(far(fp[[b[0] for b in balls]], fp[ball[0]])).tolist():
                if forest.root(other) == forest.root(me):
                    continue
                theirs = balls[other]
                for k in ball:
                    hit = np.flatnonzero(near(fp[theirs], fp[k]))
                    if len(hit):
                        links.append((int(theirs[hit[0]]), int(k)))
                        forest.join(me, other)
                        break
        balls.append(ball)
    return links, [int(b[0]) for b in balls]


def pair_links(starts: np.ndarray, ends: np.ndarray, fp: np.ndarray, near) -> list[tuple[int, int]]:
    """The same for many short lists fp[start:end] at once, by comparing each row with the ones behind it in its list."""
    if not len(starts):
        return []
    size = ends - starts
    rows = np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    end, forest, links = np.repeat(ends, size), Forest(), []
    for step in range(1, int(size.max())):
        on = rows + step < end
        rows, end = rows[on], end[on]
        for a in range(0, len(rows), BLOCK * 16):
            some = rows[a : a + BLOCK * 16]
            for k in some[near(fp[some], fp[some + step])].tolist():
                if forest.join(k, k + step):
                    links.append((k, k + step))
    return links


def _scanned(lists: DataFrame, max_bits: int, list_size: int) -> DataFrame:
    """a, b: fingerprints linked inside a list; or, where mask is set, a row of a list too long to be scanned in one go.

    Lists arrive sorted and are scanned one after the other; no more than a batch and one list of ``list_size`` rows (or
    one that has no finer keys) is in memory."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, flooded = np.zeros((0, 3), np.uint64), None  # the last part so far; the part of which rows were sent on
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in range(3)], axis=1)
            if not len(rows):
                continue
            if flooded is not None:
                more = rows[:, 0] == flooded
                yield _sent_on(rows[more])
                rows = rows[~more]
                if not len(rows):
                    continue
                flooded = None
            rows = np.concatenate([held, rows]) if len(held) else rows
            last = int(np.argmax(rows[:, 0] == rows[-1, 0]))
            yield from _closed(rows[:last], max_bits, list_size)
            held = rows[last:]
            if len(held) > list_size and not _narrow(int(held[-1, 1]), max_bits):
                yield _sent_on(held)
                held, flooded = held[:0], held[-1, 0]
        yield from _closed(held, max_bits, list_size)

    return lists.repartition("part").sortWithinPartitions("part", "mask", "fp").mapInArrow(scan, "a long, b long, mask long")


def _narrow(mask: int, max_bits: int) -> bool:
    return (64 - mask.bit_count()) // 4 <= max_bits


def _closed(rows: np.ndarray, max_bits: int, list_size: int) -> Iterator[pa.RecordBatch]:
    """Links of whole parts; rows: part, mask, fp, sorted."""
    if len(rows) < 2:
        return
    part, mask, fp = np.ascontiguousarray(rows.T)
    seen = fp & mask
    order = np.lexsort((fp, seen, mask, part))
    part, mask, fp, seen = part[order], mask[order], fp[order], seen[order]
    same = (part[1:] == part[:-1]) & (mask[1:] == mask[:-1]) & (seen[1:] == seen[:-1])
    turns = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    starts, ends = turns[::2], turns[1::2] + 1  # of lists of two and more
    near = lambda x, y: linked(x, y, max_bits)
    far = lambda x, y: np.bitwise_count(x ^ y) <= 3 * max_bits
    small = ends - starts <= min(SMALL, list_size)
    found = pair_links(starts[small], ends[small], fp, near)
    for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
        if e - s > list_size and not _narrow(int(mask[s]), max_bits):
            yield _sent_on(np.stack([part[s:e], mask[s:e], fp[s:e]], axis=1))
        else:
            found += [(s + a, s + b) for a, b in spanning_links(fp[s:e], near, far)[0]]
    if found:
        a, b = fp[np.array(found).T]
        columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(a), pa.int64())], names=["a", "b", "mask"])


def _sent_on(rows: np.ndarray) -> pa.RecordBatch:
    _, mask, fp = (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in rows.T)
    return pa.RecordBatch.from_arrays([fp, fp, mask], names=["a", "b", "mask"])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, list_size: int = LIST_SIZE) -> DataFrame:
    """a, b: links that connect what fingerprints within ``max_bits`` connect; ``fps`` has different values in column fp."""
    if not 0 < max_bits <= 4:
        raise ValueError("between 1 and 4 bits may differ")
    lists, found = postings(fps, max_bits), None
    while True:
        scanned = written(_scanned(lists, max_bits, list_size), "scanned")
        links = scanned.where("mask is null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        long = scanned.where("mask is not null").select(F.col("a").alias("fp"), "mask")
        if long.isEmpty():
            return found
        lists = _redealt(long.distinct(), max_bits)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, list_size: int = LIST_SIZE) -> DataFrame:
    """One row per input row: key, fingerprint (16 lowercase hex digits), component_id (the smallest key it reaches).

    Rows are linked if their fingerprints differ in at most ``max_bits`` bits; rows without words have fingerprint zero and
    are linked like others. Null text counts as empty. A row with a null key gets a fingerprint, and the component's
    smallest key as id (null if it has none). Repeated keys keep a row each. An empty table gives none."""
    docs = written(fingerprints(df.select(key, text), key, text, shingle).withColumnRenamed(key, "key"), "fingerprints")
    fps = docs.groupBy("fp").agg(F.min("key").alias("least"))
    reached = components(fingerprint_links(fps.select("fp"), max_bits, list_size))  # node, component: of linked fingerprints only
    group = F.coalesce("component", "fp").alias("g")
    grouped = written(fps.join(reached, fps.fp == reached.node, "left").select("fp", "least", group), "grouped")
    least = grouped.groupBy("g").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "g").select(F.col("fp").alias("f"), "component_id")
    own = unused("fingerprint") if key == "fingerprint" else "fingerprint"
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias(own)
    # a fingerprint of many rows is split by the adaptive join: nothing follows that needs them together
    return docs.join(named, docs.fp == named.f, "left").select(F.col("key").alias(key), digits, "component_id")


def deduplicated(df: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of df that stay: of each component the one with the smallest key. Rows with a null key all stay, and of
    rows with one key all or none. All columns are kept."""
    found = near_duplicates(df, key, **how)
    mark = unused("key", df)
    dropped = found.where(F.col("component_id") < F.col(key)).select(F.col(key).alias(mark)).distinct()
    return df.join(dropped, df[key] == dropped[mark], "left_anti")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
