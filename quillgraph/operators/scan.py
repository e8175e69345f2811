"""Running values over rows in order, without passing them through one task.

Rows are dealt by ranges of their order and written. A first pass sums up each range, the sums of the ranges before are folded,
and a second pass runs inside the ranges on top of what comes in. Any step that can be folded so will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.held import written

#: Kind of step: (running value in a window, sum of a range in order, fold of two sums). None of them counts nulls.
STEPS = {
    "last": (lambda c: F.last(c, ignorenulls=True), lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), lambda a, b: F.coalesce(b, a)),
    "sum": (F.sum, lambda c, o: F.sum(c), lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "max": (F.max, lambda c, o: F.max(c), lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda c, o: F.min(c), lambda a, b: F.least(a, b)),
}


def scanned(df: DataFrame, order: list[str], steps: dict[str, tuple[str, Column]], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds a column for each step: its value over the rows so far, the row itself among them, in each group of ``by``.

    steps: name -> (kind in ``STEPS``, column). Rows should be in a total order; of rows that are equal in it, each may come
    first. Null groups are a group. What is folded is a row for each range and group in it; at most one group goes on from one range
    to the next, so what comes into ranges is as many rows as there are ranges, and is broadcast."""
    by = by or []
    keyed = df.select("*", *(c.alias(f"_step_{k}") for k, (_, c) in enumerate(steps.values())))
    dealt = keyed.repartitionByRange(parts, *by, *order) if parts else keyed.repartitionByRange(*by, *order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "scan")
    kinds = [kind for kind, _ in steps.values()]
    place = F.struct(*order)
    own = [STEPS[kind][1](F.col(f"_step_{k}"), place).alias(f"_step_{k}") for k, kind in enumerate(kinds)]
    sums = dealt.groupBy(*by, "_part").agg(*own)
    sums = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_part", *(f"_step_{k}" for k in range(len(kinds)))))).alias("_all")).where(F.size("_all") > 1)
    folded = lambda a, x: F.struct(x["_part"].alias("_part"), *(STEPS[kind][2](a[f"_step_{k}"], x[f"_step_{k}"]).alias(f"_step_{k}") for k, kind in enumerate(kinds)))
    # element i: the ranges before the (i + 1)th, folded, and that one's number
    runs = F.transform(F.sequence(F.lit(2), F.size("_all")), lambda i: F.struct(F.get("_all", i - 1)["_part"].alias("_part"), F.aggregate(F.slice("_all", F.lit(2), i - 2), F.get("_all", 0), folded).alias("_before")))
    into = sums.select(*by, F.explode(runs).alias("_r")).select(*(F.col(b).alias(f"_by_{n}") for n, b in enumerate(by)), F.col("_r._part").alias("_to"), "_r._before")
    same = F.col("_part") == F.col("_to")
    for n, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{n}"))
    so_far = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({f"_step_{k}": STEPS[kind][0](F.col(f"_step_{k}")).over(so_far) for k, kind in enumerate(kinds)})
    rows = inside.join(F.broadcast(into), same, "left")
    out = [STEPS[kind][2](F.col(f"_before._step_{k}"), F.col(f"_step_{k}")).alias(name) for k, (name, kind) in enumerate(zip(steps, kinds, strict=True))]
    return rows.select(*(c for c in df.columns if c not in steps), *out)
