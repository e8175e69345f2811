"""The graph as a store of unique nodes and edges: (label, name) identifies a node, its ends and relation an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import PROPERTIES
from .held import dealt


def upserted_nodes(rows: DataFrame) -> DataFrame:
    """label, name and properties: one row for each (label, name), the properties of the last one. rows: seq, label, name."""
    props = [c for c in rows.columns if c in PROPERTIES and c != "category"]
    kept = rows.where("name <> ''").groupBy("label", "name").agg(F.max_by(F.struct(F.lit(1).alias("_"), *props), "seq").alias("p"))
    return kept.select("label", "name", *(F.col(f"p.{c}") for c in props))


def upserted_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source_type, source, relation, target_type, target, each once, of edges whose typed ends are nodes."""
    columns = ["source_type", "source", "relation", "target_type", "target"]
    rows = edges.where("source <> '' and relation <> '' and target <> ''").select(*columns)
    rows = dealt(rows.withColumn("_h", F.xxhash64(*columns)), "_h").distinct()
    for e in ("source", "target"):  # sorted by a hash before the texts
        names = [f"{e}_type", e]
        ends = nodes.select(F.col("label").alias(names[0]), F.col("name").alias(e)).distinct().withColumn("_h", F.xxhash64(*names))
        rows = rows.withColumn("_h", F.xxhash64(*names)).join(ends, ["_h", *names], "left_semi")
    return rows.select(*columns)


def import_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: success (complete edges, matched or not), failed (incomplete ones), unmatched (complete without both nodes)."""
    whole = F.coalesce((F.col("source") != "") & (F.col("relation") != "") & (F.col("target") != ""), F.lit(False))
    rows = edges.select(*("source_type source relation target_type target".split()), whole.alias("whole"))
    for k, e in enumerate(("source", "target")):
        ends = nodes.select(F.col("label").alias(f"{e}_type"), F.col("name").alias(e)).distinct().withColumn(f"has{k}", F.lit(True))
        rows = rows.join(ends, [f"{e}_type", e], "left")
    both = F.coalesce(F.col("has0") & F.col("has1"), F.lit(False))
    return rows.agg(F.count_if("whole").alias("success"), F.count_if(~F.col("whole")).alias("failed"), F.count_if(F.col("whole") & ~both).alias("unmatched"))


def repeated_nodes(rows: DataFrame) -> DataFrame:
    """label, name, n of what breaks uniqueness."""
    return rows.groupBy("label", "name").agg(F.count("*").alias("n")).where("n > 1")


def countries(base: DataFrame, entities: DataFrame) -> DataFrame:
    """name of all countries, those that were extracted among them, sorted."""
    return base.select("name").unionByName(entities.where("label = 'Country'").select("name")).distinct().orderBy("name")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: nodes by label and edges by relation, each with a total (name null)."""
    of = lambda df, c, kind: df.rollup(c).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")
    return of(nodes, "label", "node").unionByName(of(edges, "relation", "edge"))


def replace(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Truncates the store and loads it anew, partitioned by label and by relation."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{folder}/edges")


