"""What a node's card shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text
from . import graph


def profile(nodes: DataFrame, metrics: list[tuple[str, str, str, float]] = v.METRICS, keep: list[str] | None = None, kilometres: bool = False) -> DataFrame:
    """name, key, metric, value, display_value, unit, score, max_value: a row for each metric that a node has a number for.

    score is the share of the scale's largest value in percent, between 0 and 100, to one decimal; display_value has two."""
    rows = []
    for k, (key, name, unit, most) in enumerate(metrics):
        raw = (F.col(key) if key in nodes.columns else F.lit(None)).cast("string")
        value = text.number(F.replace(raw, F.lit(v.UNIT)) if key == "caliber" else raw, kilometres)
        score = F.round(F.least(F.greatest(value / most * 100, F.lit(0.0)), F.lit(100.0)), 1)
        rows.append(F.struct(F.lit(k).alias("ord"), F.lit(key).alias("key"), F.lit(name).alias("metric"), value.alias("value"), F.round(value, 2).alias("display_value"), F.lit(unit).alias("unit"), score.alias("score"), F.lit(most).alias("max_value")))
    return nodes.select(*(keep or ["name"]), F.inline(F.filter(F.array(*rows), lambda r: r["value"].isNotNull())))


def brief(nodes: DataFrame) -> DataFrame:
    """name, ord, attribute, value: six lines, unknown where there is nothing."""
    shown = [("类别", "category", ""), ("口径", "caliber", ""), ("型号", "model", ""), ("页码", "page", ""), ("射程", "range", " 米"), ("重量", "weight", " 千克")]
    cell = lambda c, unit: F.coalesce(F.concat(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(unit)), F.lit(v.UNKNOWN))
    rows = [F.struct(F.lit(k).alias("ord"), F.lit(name).alias("attribute"), cell(c, unit).alias("value")) for k, (name, c, unit) in enumerate(shown)]
    return nodes.select("name", F.inline(F.array(*rows)))


def radar(profiled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """name, metrics, scores: closed polygons, the first corner repeated at the end."""
    rows = profiled.where(F.col("key").isin(keys)) if keys else profiled
    corners = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("ord", "metric", "score"))).alias("c"))
    closed = F.concat("c", F.slice("c", 1, 1))
    return corners.select("name", F.transform(closed, lambda x: x["metric"]).alias("metrics"), F.transform(closed, lambda x: x["score"]).alias("scores"))


#: Parameters, members of a relation, related names and edges that a panel shows at most.
PANEL_PARAMETERS, PANEL_MEMBERS, PANEL_RELATED, PANEL_EDGES = 4, 12, 18, 8


def panel(g: graph.Graph, name: str, label: str = "Artillery") -> DataFrame:
    """section, ord, key, value: what the panel of a node shows; no rows for a name that is no node.

    For a node of ``label``: attributes (six lines), parameters (the first ones with numbers) and relations (the first members
    of each, by name). For others: counts of edges in and out, the nodes of ``label`` that point at it, and its first edges out
    and in, in order."""
    own = g.nodes.where(F.col("name") == name)
    found = own.select("label").first()
    row = lambda section, ord_, key, value: [F.lit(section).alias("section"), ord_.cast("int").alias("ord"), key.alias("key"), value.cast("string").alias("value")]
    if found is None:
        return g.nodes.limit(0).select(*row("", F.lit(0), F.lit(""), F.lit("")))
    if found.label == label:
        lines = brief(own).select(*row("attributes", F.col("ord"), F.col("attribute"), F.col("value")))
        numbers = profile(own).orderBy("ord").limit(PANEL_PARAMETERS).select(*row("parameters", F.col("ord"), F.col("metric"), F.concat(F.col("display_value").cast("string"), F.lit(" "), F.col("unit"))))
        members = graph.relation_groups(g, name).select("relation_label", F.posexplode(F.slice("members", 1, PANEL_MEMBERS)).alias("k", "m"))
        return lines.unionByName(numbers).unionByName(members.select(*row("relations", F.col("k"), F.col("relation_label"), F.col("m"))))
    into, out = g.edges.where(F.col("target") == name), g.edges.where(F.col("source") == name)
    counts = [df.agg(F.count("*").alias("n")).select(*row("counts", F.lit(k), F.lit(side), F.col("n"))) for k, (side, df) in enumerate((("in", into), ("out", out)))]

    def first(section: str, df: DataFrame, key, value, most: int) -> DataFrame:
        top = df.orderBy("seq").limit(most).withColumn("n", F.row_number().over(Window.orderBy("seq")) - 1)  # of a handful of rows
        return top.select(*row(section, F.col("n"), key, value))

    near = first("related", into.where(F.col("source_type") == label), F.lit(""), F.col("source"), PANEL_RELATED)
    edges = first("out", out, F.col("relation_label"), F.col("target"), PANEL_EDGES).unionByName(first("in", into, F.col("relation_label"), F.col("source"), PANEL_EDGES))
    return counts[0].unionByName(counts[1]).unionByName(near).unionByName(edges)
