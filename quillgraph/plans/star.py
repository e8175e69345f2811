"""The test tables as entities, edges, texts and outlines: parts are entities, what they belong to are other nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..operators import graph
from ..sources.held import dealt

#: Edges of kinds 1 to 5 are numbered apart, and so are the edges of a part.
KIND, OWN = 10**18, 10**9


def part() -> Column:
    return F.concat(F.lit("part#"), F.col("p_partkey").cast("string"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """seq, name, label and properties: parts, then suppliers, then nations."""
    p, s, n = (table(spark, sf, t) for t in ("part", "supplier", "nation"))
    text = lambda c: F.col(c).cast("string")
    parts = p.select(
        F.col("p_partkey").alias("seq"), part().alias("name"), F.lit("Artillery").alias("label"), F.col("p_type").alias("category"), F.concat(text("p_size"), F.lit(v.UNIT)).alias("caliber"), F.col("p_brand").alias("model"),
        F.col("p_name").alias("core_model"), (F.col("p_partkey") % 367).cast("int").alias("page"), F.concat(F.floor("p_retailprice").cast("string"), F.lit("米")).alias("range"), text("p_size").alias("weight"),
    )
    more = s.select((F.lit(KIND) + F.col("s_suppkey")).alias("seq"), F.col("s_name").alias("name"), F.lit("Supplier").alias("label"))
    lands = n.select((F.lit(2 * KIND) + F.col("n_nationkey")).alias("seq"), F.col("n_name").alias("name"), F.lit("Country").alias("label"))
    return parts.unionByName(more.unionByName(lands), allowMissingColumns=True)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """seq and typed edges: kind and maker of parts (base), the land of their first supplier, the lands that they were sold to,
    and their suppliers (rule). Lineitem is read for the lands sold to, and for the pairs of parts and suppliers."""
    p, s, n, c, o, li = (table(spark, sf, t) for t in ("part", "supplier", "nation", "customer", "orders", "lineitem"))
    made = lambda df, kind, own, relation, target, target_type, method: df.select((F.lit(kind * KIND) + F.col("p_partkey") * OWN + own).alias("seq"), part().alias("source"), F.lit("Artillery").alias("source_type"), F.lit(relation).alias("relation"), F.col(target).alias("target"), F.lit(target_type).alias("target_type"), F.lit(method).alias("method"), F.lit("").alias("description"))
    lots = li.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey")
    pairs = dealt(lots.select("p_partkey", "l_suppkey"), "p_partkey", "l_suppkey").distinct()  # read once: both plans below begin with this exchange
    first = pairs.groupBy("p_partkey").agg(F.min("l_suppkey").alias("s_suppkey")).join(s, "s_suppkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    buyers = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("n_nationkey"))
    sold = lots.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select("p_partkey", "n_nationkey")
    sold = dealt(sold, "p_partkey", "n_nationkey").distinct().join(n, "n_nationkey")
    by = pairs.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    zero = F.lit(0)
    return (
        made(p, 1, zero, "IS_TYPE_OF", "p_type", "Category", "base")
        .unionByName(made(p, 2, zero, "DESIGNED_BY", "p_brand", "Institution", "base"))
        .unionByName(made(first, 3, zero, "DEVELOPED_IN", "n_name", "Country", "base"))
        .unionByName(made(sold, 4, F.col("n_nationkey"), "EQUIPPED_BY", "n_name", "Country", "rule"))
        .unionByName(made(by, 5, F.col("s_suppkey"), "SUPPLIED_BY", "s_name", "Supplier", "rule"))
    )


def build(spark: SparkSession, sf: str, view: str = "trusted", once: bool = False) -> graph.Graph:
    return graph.build(entities(spark, sf), edges(spark, sf), view, once=once)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """name, text: documents as the texts of parts."""
    return table(spark, sf, "documents").select(F.concat(F.lit("part#"), F.col("doc_id").cast("string")).alias("name"), "text")


ENTITIES_SQL = """ent AS (
    SELECT p_partkey AS seq, 'part#' || p_partkey AS name, 'Artillery' AS label, p_type AS category, p_size || '毫米' AS caliber, p_brand AS model, p_name AS core_model,
           CAST(p_partkey % 367 AS INT) AS page, CAST(floor(p_retailprice) AS BIGINT) || '米' AS range, CAST(p_size AS VARCHAR) AS weight FROM part
    UNION ALL SELECT 1000000000000000000 + s_suppkey, s_name, 'Supplier', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 2000000000000000000 + n_nationkey, n_name, 'Country', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM nation)"""
EDGES_SQL = """raw AS (
    SELECT 1000000000000000000 + p_partkey * 1000000000 AS seq, 'part#' || p_partkey AS source, 'Artillery' AS source_type, 'IS_TYPE_OF' AS relation, p_type AS target, 'Category' AS target_type, 'base' AS method FROM part
    UNION ALL SELECT 2000000000000000000 + p_partkey * 1000000000, 'part#' || p_partkey, 'Artillery', 'DESIGNED_BY', p_brand, 'Institution', 'base' FROM part
    UNION ALL SELECT 3000000000000000000 + l_partkey * 1000000000, 'part#' || l_partkey, 'Artillery', 'DEVELOPED_IN', n_name, 'Country', 'base'
              FROM (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey) JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 4000000000000000000 + l_partkey * 1000000000 + n_nationkey, 'part#' || l_partkey, 'Artillery', 'EQUIPPED_BY', n_name, 'Country', 'rule'
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT 5000000000000000000 + l_partkey * 1000000000 + s_suppkey, 'part#' || l_partkey, 'Artillery', 'SUPPLIED_BY', s_name, 'Supplier', 'rule'
              FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_NODES = """{n} AS (
    SELECT name, min(place) AS place, min(place).kind AS kind, min(place).entity AS entity, min(place).edge AS edge, min(place)."end" AS "end", arg_min(label, place) AS label, max(category) AS category, max(caliber) AS caliber, max(model) AS model, max(core_model) AS core_model, max(page) AS page, max(range) AS range, max(weight) AS weight
    FROM (SELECT {{'kind': 0, 'entity': seq, 'edge': CAST(NULL AS BIGINT), 'end': 0}} AS place, * EXCLUDE (seq) FROM ent WHERE {shown}
          UNION ALL SELECT {{'kind': 1, 'entity': NULL, 'edge': seq, 'end': 0}}, source, source_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {e}
          UNION ALL SELECT {{'kind': 1, 'entity': NULL, 'edge': seq, 'end': 1}}, target, target_type, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {e}) GROUP BY name)"""
_SHOWN = "label IN ('Artillery', 'Country', 'Category', 'Institution', 'Designer', 'Ammunition', 'Derivative', 'War', 'Chassis')"
_LABEL = "CASE relation WHEN 'IS_TYPE_OF' THEN '类型' WHEN 'DESIGNED_BY' THEN '设计方' WHEN 'DEVELOPED_IN' THEN '研发国家' WHEN 'EQUIPPED_BY' THEN '装备国家' ELSE relation END AS relation_label"
#: Common table expressions of both views: nodes and edges (n, e) of the trusted one, and (fn, fe) of the full one.
GRAPH_SQL = ", ".join([
    ENTITIES_SQL, EDGES_SQL,
    f"fe AS (SELECT *, {_LABEL} FROM (SELECT *, row_number() OVER (PARTITION BY source, relation, target ORDER BY seq) AS k FROM raw) WHERE k = 1)",
    "e AS (SELECT * FROM fe WHERE relation IN ('DEVELOPED_IN', 'IS_TYPE_OF', 'DESIGNED_BY', 'EQUIPPED_BY'))",
    _NODES.format(n="n", e="e", shown=_SHOWN), _NODES.format(n="fn", e="fe", shown="true"),
])
