"""Coordinates of a drawn graph."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..sources.held import written

#: Placed targets of edges up to which they are broadcast.
FEW = 100_000


def numbered(rows: DataFrame, by: str, order: str, out: str = "idx") -> DataFrame:
    """Adds the place of each row in its group, from 0. The rows are dealt by ranges of (group, order) and numbered inside
    each range, on top of what lies in the ranges before, so a group of all rows is no one task's."""
    dealt = written(rows.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = dealt.groupBy(by, "_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(by).orderBy("_part")) - F.col("_rows")  # a row for each range and group in it
    inside = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)) - 1
    return dealt.withColumn("_at", inside).join(counts.withColumn("_before", before).drop("_rows"), [by, "_part"]).withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def positions(nodes: DataFrame, center: str | None = None, order: list[str] = v.RING_ORDER, radii: dict[str, float] = v.RING_RADII) -> DataFrame:
    """name, label, x, y. nodes: seq, name, label; nodes of a label stand on one ring, in order of seq.

    Around a center, rings follow each other at steps of 1.2, in the given order of labels, unknown labels sorted behind
    them, empty ones left out; the center stands at (0, 0). Without one each label has its radius (unknown ones 0.9 apart
    from 1.1 beyond the largest), rings are turned against each other by 0.37, and every fifth node repeats an offset."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("label")).cast("int") - 1
    place = Window.orderBy("known", F.when(F.col("known") == 1, F.col("label")), "rank")
    rest = nodes.where(F.col("name") != center) if center is not None else nodes
    labels = rest.groupBy("label").agg(F.count("*").alias("total")).withColumn("rank", rank).withColumn("known", F.when(F.col("rank") < 0, 1).otherwise(0))
    labels = labels.withColumn("ring", F.row_number().over(place))  # of a handful of labels
    extra = F.row_number().over(Window.partitionBy("known").orderBy("label")) - 1
    fixed = F.element_at(F.create_map(*(F.lit(x) for pair in radii.items() for x in pair)), F.col("label"))
    at = F.when(F.col("known") == 0, F.col("rank")).otherwise(F.lit(len(order)) + F.col("extra"))
    labels = labels.withColumn("extra", extra).withColumn("at", at).withColumn("radius", F.when(F.col("known") == 0, fixed).otherwise(F.lit(max(radii.values()) + 1.1) + 0.9 * F.col("extra")))
    rows = numbered(rest.select("seq", "name", "label"), "label", "seq").join(labels, "label")
    angle = 2 * math.pi * F.col("idx") / F.col("total")
    if center is not None:
        r, a = 1.2 * F.col("ring"), angle
    else:
        r, a = F.col("radius") + 0.18 * (F.pmod("idx", F.lit(5)) - 2), angle + 0.37 * F.col("at")
    out = rows.select("name", "label", (r * F.cos(a)).alias("x"), (r * F.sin(a)).alias("y"))
    if center is None:
        return out
    return out.unionByName(nodes.where(F.col("name") == center).select("name", "label", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def segments(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """source, relation, target and x0, y0, x1, y1, mid_x, mid_y of edges whose ends are placed. Edges stay where they lie for their
    targets, as long as few nodes are targets, so a target of most edges is no hot key."""
    ends = [placed.select(F.col("name").alias(e), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}")) for k, e in enumerate(("source", "target"))]
    hit = written(ends[1].join(edges.select("target").distinct(), "target", "left_semi"), "targets-placed")
    rows = edges.select("source", "relation", "target").join(ends[0], "source").join(F.broadcast(hit) if hit.count() <= FEW else hit, "target")
    mid = lambda c: ((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"mid_{c}")
    return rows.select("source", "relation", "target", "x0", "y0", "x1", "y1", mid("x"), mid("y"))
