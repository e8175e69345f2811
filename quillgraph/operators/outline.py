"""From an outline to entities and their first edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import match
from . import scan


def filled_forward(df: DataFrame, value: Column, header: Column, order: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the last non-null value among header rows so far. A header with a null value does not reset it.

    Groups of ``by`` (documents, say) are each read by one task; without it the rows are scanned by ranges of their order."""
    if not by:
        return scan.scanned(df, [order], {out: ("last", F.when(header, value))})
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(F.when(header, value), ignorenulls=True).over(so_far))


def chapter_of(title: Column, chapters: match.Dictionary = v.CHAPTERS) -> Column:
    """Category of the first chapter that the title names; null if none."""
    return F.get(F.transform(F.filter(match.literal(chapters), lambda c: F.contains(title, c["name"])), lambda c: F.get(c["words"], 0)), 0)


def entities(toc: DataFrame, by: list[str] | None = None, chapters: match.Dictionary = v.CHAPTERS, prefixes: match.Dictionary = v.COUNTRY_PREFIXES, suffixes: list[str] = v.SUFFIXES, modifiers: list[str] = v.MODIFIERS) -> DataFrame:
    """seq, name, model, core_model, caliber, category, subtype, page, countries of the level-2 titles under a known chapter
    that start with a country and end in a known kind. toc: seq, level, title, page, and the columns of ``by``, which stay."""
    rows = filled_forward(toc, chapter_of(F.col("title"), chapters), F.col("level") == 1, "seq", "category", by)
    rows = rows.where((F.col("level") == 2) & F.col("category").isNotNull()).withColumn("name", match.cleaned_title(F.col("title")))
    rows = rows.withColumn("found", match.prefix_match(F.col("name"), prefixes)).where("found is not null")
    rows = rows.withColumn("parts", match.title_parts(F.col("found.rest"), suffixes)).where("parts is not null")
    model = F.col("parts.model")
    return rows.select(
        *(by or []), "seq", "name", model.alias("model"), match.without(model, modifiers).alias("core_model"), F.col("parts.caliber").alias("caliber"), "category",
        match.first_contained(model, modifiers).alias("subtype"), "page", F.col("found.names").alias("countries"),
    )


def base_edges(found: DataFrame) -> DataFrame:
    """seq (an array: the entity's and the place among its edges), source, source_type, relation, target, target_type:
    developer (the first country), other countries, category."""
    to = lambda relation, target, kind, k: F.struct(k.alias("k"), F.lit(relation).alias("relation"), target.alias("target"), F.lit(kind).alias("target_type"))
    n = F.size("countries")
    first = F.array(to("DEVELOPED_IN", F.get("countries", 0), "Country", F.lit(0)))
    rest = F.transform(F.slice("countries", 2, F.greatest(n - 1, F.lit(0))), lambda c, k: to("EQUIPPED_BY", c, "Country", k + 1))
    last = F.array(to("IS_TYPE_OF", F.col("category"), "Category", n))
    rows = found.select("seq", F.col("name").alias("source"), F.lit("Artillery").alias("source_type"), F.explode(F.concat(first, rest, last)).alias("e"))
    return rows.select(F.array(F.col("seq").cast("long"), F.col("e.k").cast("long")).alias("seq"), "source", "source_type", "e.relation", "e.target", "e.target_type")
