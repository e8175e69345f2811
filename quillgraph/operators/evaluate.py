"""Precision, recall and F1 of one set of entities and relations against another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..sources.held import dealt

ENTITY, RELATION = ["label", "name"], ["source", "relation", "target"]


def triples(edges: DataFrame) -> DataFrame:
    """source, relation, target without white space around them, a row for each edge, incomplete ones left out."""
    rows = edges.select(*(stripped(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in RELATION))
    return rows.where("source <> '' and relation <> '' and target <> ''")


def normalised(edges: DataFrame) -> DataFrame:
    """The triples, each once."""
    return triples(edges).distinct()


def gold_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """label, name of a reference set: entities, and the stripped ends of edges."""
    ends = [edges.select(F.col(f"{e}_type").alias("label"), stripped(F.col(e)).alias("name")) for e in ("source", "target")]
    return _named(entities.select(*ENTITY).unionByName(ends[0]).unionByName(ends[1]))


def machine_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """label, name of an extracted set: entities, and the ends of edges as they are."""
    ends = [edges.select(F.col(f"{e}_type").alias("label"), F.col(e).alias("name")) for e in ("source", "target")]
    return _named(entities.select(*ENTITY).unionByName(ends[0]).unionByName(ends[1]))


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("label <> '' and name <> ''").distinct()


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scored(rows: DataFrame, digits: int) -> DataFrame:
    p, r = ratio(F.col("tp"), F.col("machine_count")), ratio(F.col("tp"), F.col("gold_count"))
    shown = [F.round(x, digits).alias(n) for x, n in ((p, "precision"), (r, "recall"), (ratio(2 * p * r, p + r), "f1"))]
    return rows.select(*[c for c in rows.columns if c not in ("tp", "gold_count", "machine_count")], *shown, "tp", (F.col("machine_count") - F.col("tp")).alias("fp"), (F.col("gold_count") - F.col("tp")).alias("fn"), "gold_count", "machine_count")


def _both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of either set once, with g and m: whether it is in a and in b. One shuffle, no join."""
    sides = [df.select(*keys, F.lit(g).alias("g"), F.lit(m).alias("m")) for df, g, m in ((a, 1, 0), (b, 0, 1))]
    return dealt(sides[0].unionByName(sides[1]), *keys).groupBy(*keys).agg(F.max("g").alias("g"), F.max("m").alias("m"))


def compare(gold: DataFrame, machine: DataFrame, keys: list[str], by: str | None = None, digits: int = 4) -> DataFrame:
    """precision, recall, f1, tp, fp, fn, gold_count, machine_count over the sets of rows by ``keys``, for each value of one of
    them with ``by``; 0 where a ratio has no denominator."""
    both = _both(gold, machine, keys)
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.col("g") * F.col("m"), "tp"), (F.col("g"), "gold_count"), (F.col("m"), "machine_count"))]
    return _scored((both.groupBy(by) if by else both).agg(*sums), digits)


def large_enough(gold: DataFrame, edges: DataFrame, entities: int = 200, relations: int = 400) -> DataFrame:
    """One row: the two sizes asked for and whether the reference set reaches them."""
    rows = gold.agg(F.count("*").alias("e")).join(F.broadcast(edges.agg(F.count("*").alias("r"))))
    return rows.select(F.lit(entities).alias("entity_requirement"), F.lit(relations).alias("relation_requirement"), (F.col("e") >= entities).alias("entity_passed"), (F.col("r") >= relations).alias("relation_passed"))


def common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _both(a, b, keys).where("g = 1 and m = 1").select(*keys)


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _both(a, b, keys).where("g = 1 and m = 0").select(*keys)
