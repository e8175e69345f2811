"""Connected components of a table of links, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task contracts at once; more are taken up in further rounds.
CONTRACT_AT_ONCE = 500_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars around the smallest node of each of its own components."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = x = top[y]
        return x

    def stars() -> pa.RecordBatch:
        own = [(x, r) for x in top if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in own], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                top[max(a, b)] = min(a, b)
        if len(top) > CONTRACT_AT_ONCE:
            yield stars()
            top.clear()
    yield stars()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """node, component: each node of a link with the smallest node that it reaches. ``links``: two columns of longs.

    Links of a node with itself and null ends are ignored. Alternates two steps until nothing changes: each node's larger
    neighbours are hung on its smallest neighbour, then its smaller neighbours are. The number of rounds grows with the
    logarithm of the longest path. Minima are pre-aggregated before the shuffle, so a node of many links costs no more
    than others, and each round is a written table, so a lost executor costs no earlier round."""
    a, b = links.columns[:2]
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where("u <> v").distinct(), "edges")
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
