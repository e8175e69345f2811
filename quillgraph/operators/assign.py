"""Pages to entities by range, and what is known of each entity joined to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

#: Last page of the last entity, and pages of which the starts are looked at in one task.
LAST_PAGE, BLOCK = 367, 4096


def ranges(found: DataFrame, last_page: int = LAST_PAGE, by: list[str] | None = None) -> DataFrame:
    """found with first and last page of each entity: up to the page before the next entity's. Of entities on one page, in
    order of seq, all but the last get an empty range. The next start is looked up inside a block of pages, and where there
    is none in a table of each block's first start, so one long book is not one task."""
    keys, block = by or [], F.floor(F.col("page") / BLOCK)
    starts = found.groupBy(*keys, block.alias("_block")).agg(F.min("page").alias("_first"))
    starts = starts.withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_first")  # a row for each block
    starts = starts.withColumnsRenamed({k: f"_{n}" for n, k in enumerate(keys)}).withColumnRenamed("_block", "_of")
    rows = found.withColumn("_block", block).withColumn("_lead", F.lead("page").over(Window.partitionBy(*keys, "_block").orderBy("page", "seq")))
    same = F.col("_block").eqNullSafe(F.col("_of"))
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{n}"))
    last = F.coalesce(F.coalesce("_lead", "_next") - 1, F.lit(last_page))
    return rows.join(starts, same, "left").select(*found.columns, F.col("page").alias("first"), last.alias("last"))


def pages_of(ranged: DataFrame, pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A row for each entity and page of its range. Ranges are disjoint, so the range of a page is the last one that starts by it,
    if it has not ended: starts and the numbers of the pages that are there are scanned in one order. A range costs its start,
    however long it is; texts are joined by page afterwards."""
    by, known = by or [], F.lit(True)
    for b in by:
        known = known & F.col(b).isNotNull()
    own = F.struct(*(c for c in ranged.columns if c not in by))
    starts = ranged.where((F.col("first") <= F.col("last")) & known).select(*by, F.col("first").cast("long").alias("page_no"), F.lit(0).alias("_kind"), own.alias("_range"))
    numbers = pages.where(F.col("page").isNotNull() & known).select(*by, F.col("page").cast("long").alias("page_no"), F.lit(1).alias("_kind")).distinct()
    rows = scan.scanned(starts.unionByName(numbers, allowMissingColumns=True), ["page_no", "_kind"], {"_held": ("last", F.col("_range"))}, by)
    numbered = rows.where((F.col("_kind") == 1) & (F.col("page_no") <= F.col("_held.last"))).select(*by, F.col("page_no").cast(pages.schema["page"].dataType).alias("page_no"), "_held.*")
    return numbered.join(pages.withColumnRenamed("page", "page_no"), [*by, "page_no"])


def texts(ranged: DataFrame, pages: DataFrame, by: list[str] | None = None, blank: bool = False, order: list[str] | None = None) -> DataFrame:
    """name, text: the entity's pages in order, a line feed between, empty pages left out; empty without any. With ``blank`` empty
    pages count, and an entity without a text has null. order: columns of pages by which those with one number stand, before their texts."""
    shown = pages.where(F.col("text").isNotNull() if blank else F.col("text") != "")
    rows = pages_of(ranged, shown, by).groupBy(*(by or []), "seq", "name").agg(F.array_sort(F.collect_list(F.struct("page_no", *(order or []), "text"))).alias("p"))
    joined = rows.select(*(by or []), "seq", "name", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    out = ranged.select(*(by or []), "seq", "name").join(joined, [*(by or []), "seq", "name"], "left")
    return out if blank else out.withColumn("text", F.coalesce("text", F.lit("")))


def with_texts(found: DataFrame, by_name: DataFrame) -> DataFrame:
    """found with the text of its name, empty if there is none."""
    return found.join(by_name.select("name", "text"), "name", "left").withColumn("text", F.coalesce("text", F.lit("")))


def with_images(found: DataFrame, paths: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """found with image_path and image_method of its name, empty if there is none."""
    out = found.join(paths.select("name", F.col("path").alias("image_path")), "name", "left")
    if meta is not None:
        out = out.join(meta.select("name", F.col("method").alias("image_method")), "name", "left").withColumn("image_method", F.coalesce("image_method", F.lit("")))
    return out.withColumn("image_path", F.coalesce("image_path", F.lit("")))


def with_old_parameters(found: DataFrame, old: DataFrame) -> DataFrame:
    """found with the parameters that an earlier run left for its name, an empty map if none."""
    return found.drop("parameters").join(old.select("name", "parameters"), "name", "left").withColumn("parameters", F.coalesce("parameters", F.create_map().cast("map<string,string>")))


def entity_of_page(found: DataFrame, page_count: int) -> DataFrame:
    """page, name: the last entity that names a page, for pages that exist."""
    return found.where(F.col("page") < page_count).groupBy("page").agg(F.max_by("name", "seq").alias("name"))


def parameter_total(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum(F.size("parameters")), F.lit(0)).cast("long").alias("n_parameters"))
