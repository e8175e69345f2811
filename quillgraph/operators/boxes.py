"""Choosing the main picture of a page: scores of layout blocks and of connected areas, dense bands, crops.

Pixels come in through ``pictures``; what is scored and chosen are columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_score(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Of a layout block on a page; -1 for one too small or too large."""
    w, h = F.greatest(x1 - x0, F.lit(1.0)), F.greatest(y1 - y0, F.lit(1.0))
    share, middle = w * h / (width * height), (y0 + y1) / 2 / height
    bonus = F.when(middle.between(0.18, 0.78), 20.0).otherwise(0.0) + F.when((w / h).between(1.0, 3.8), 10.0).otherwise(0.0)
    malus = F.when(y0 < 0.08 * height, 8.0).otherwise(0.0) + F.when(y1 > 0.92 * height, 8.0).otherwise(0.0)
    return F.when((w < 0.18 * width) | (h < 0.10 * height) | (share > 0.88), -1.0).otherwise(100 * share + bonus - malus)


def area_score(x: Column, y: Column, w: Column, h: Column, area: Column, spread: Column, width: Column, height: Column) -> Column:
    """Of a connected area with the spread of its grey values; null for one that is no candidate."""
    aspect, share = w / F.greatest(h, F.lit(1)), area / (width * height)
    out = (w < 0.22 * width) | (h < 0.08 * height) | (share < 0.03) | (y > 0.78 * height)
    plus = lambda fits, points: F.when(fits, points).otherwise(0.0)
    score = 100 * share + plus(aspect.between(1.1, 3.8), 18.0) + plus(y < 0.58 * height, 20.0) + F.when(spread > 28, 18.0).when(spread > 18, 8.0).otherwise(0.0)
    score = score + plus(w > 0.45 * width, 8.0) + plus(h > 0.12 * height, 8.0)
    score = score - plus((x < 0.04 * width) | (x + w > 0.96 * width), 6.0) - plus(y < 0.05 * height, 6.0)
    return F.when(~out, score)


def padded(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """(x0, y0, x1, y1) widened by 2 % and 3 % of the area's own size, inside the page, whole numbers."""
    px, py = (w * 0.02).cast("int"), (h * 0.03).cast("int")
    return F.struct(F.greatest(x - px, F.lit(0)).alias("x0"), F.greatest(y - py, F.lit(0)).alias("y0"), F.least(x + w + px, width).alias("x1"), F.least(y + h + py, height).alias("y1"))


def dense_bands(values: DataFrame, ratio: float, least: int | str, by: list[str], at: str = "idx", value: str = "value") -> DataFrame:
    """by, first, last: in each group the longest run of at least ``least`` places whose value reaches ``ratio`` of the
    group's largest; the first of equals. ``least`` may be a column that is the same for all rows of a group. Groups without a
    positive value have none."""
    values = values.withColumn("_l", F.col(least) if isinstance(least, str) else F.lit(least))
    most = values.withColumn("_m", F.max(value).over(Window.partitionBy(*by)))
    dense = most.where((F.col("_m") > 0) & (F.col(value) >= ratio * F.col("_m")))
    runs = dense.withColumn("_r", F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at)))
    runs = runs.groupBy(*by, "_r").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max("_l").alias("_l")).withColumn("_n", F.col("last") - F.col("first") + 1).where(F.col("_n") >= F.col("_l"))
    best = runs.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), "first", "last")).alias("b"))
    return best.select(*by, "b.first", "b.last")


def best(candidates: DataFrame, by: list[str], score: str = "score", order: str = "seq", least: float = 0.0) -> DataFrame:
    """Of each group the row with the highest score, the first of equals; scores under ``least`` and null ones do not count."""
    rows = candidates.where(F.col(score) >= least)
    own = Window.partitionBy(*by).orderBy(F.desc(score), order)
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def wanted_pages(books: DataFrame, first: int = 12, last: int = 367) -> DataFrame:
    """The rows of books (with n_pages) once for each page number from first to the lesser of last and n_pages."""
    end = F.least(F.lit(last), F.col("n_pages")).cast("int")
    return books.where(end >= first).withColumn("page", F.explode(F.sequence(F.lit(first), end)))


#: Fixed value: the kind of a layout block that is a picture.
PICTURE = 1


def main_pictures(pages: DataFrame, blocks: DataFrame, areas: DataFrame, ink: DataFrame) -> DataFrame:
    """page, method, x0, y0, x1, y1: the main picture of each page, by the first way that gives one.

    The layout's best picture block (image_block, in units of the page); else the best connected area, widened
    (page_photo_component, in pixels as all that follows); else the rows and columns with the most ink, 20 pixels around
    (page_density_crop, eight to ninety-two hundredths of the width where no columns stand out); else sixteen to sixty-eight
    hundredths of the height (page_density_fallback). pages: page, width, height of the layout, pixel_width, pixel_height.
    blocks: page, seq, kind, x0, y0, x1, y1. areas: page, seq, x, y, w, h, area, spread. ink: page, y, x, n dark pixels there."""
    # every table grows with the pages, and Spark takes them for as small as their packed files: none is to be broadcast
    pages, blocks, areas, ink = (df.hint("merge") for df in (pages, blocks, areas, ink))
    size, whole = pages.select("page", "pixel_width", "pixel_height"), lambda c: c.cast("int")
    c = F.col
    scored = blocks.where(c("kind") == PICTURE).join(pages, "page").withColumn("score", block_score(c("x0"), c("y0"), c("x1"), c("y1"), c("width"), c("height")))
    block = best(scored, ["page"]).select("page", F.struct(F.lit("image_block").alias("method"), *(c(x).cast("double").alias(x) for x in CORNERS)).alias("block")).hint("merge")
    scored = areas.join(size, "page").withColumn("score", area_score(c("x"), c("y"), c("w"), c("h"), c("area"), c("spread"), c("pixel_width"), c("pixel_height"))).where("score > -1")
    scored = best(scored, ["page"], least=-1.0).withColumn("p", padded(c("x"), c("y"), c("w"), c("h"), c("pixel_width"), c("pixel_height")))
    area = scored.select("page", F.struct(F.lit("page_photo_component").alias("method"), *(c(f"p.{x}").cast("double").alias(x) for x in CORNERS)).alias("area")).hint("merge")
    left = size.join(block, "page", "left_anti").join(area, "page", "left_anti").hint("merge")
    dark = ink.join(left, "page")
    rows = dark.groupBy("page", "y", "pixel_height").agg(F.sum("n").alias("value")).withColumn("least", F.greatest(F.lit(120), whole(F.floor(c("pixel_height") / 8))))
    rows = dense_bands(rows, 0.34, "least", ["page"], "y").hint("merge")
    band = left.join(rows, "page").select(left["*"], F.greatest(c("first") - 20, F.lit(0)).alias("y0"), F.least(c("last") + 20, c("pixel_height")).alias("y1")).hint("merge")
    columns = ink.join(band, "page").where((c("y") >= c("y0")) & (c("y") < c("y1"))).groupBy("page", "x", "pixel_width").agg(F.sum("n").alias("value"))
    columns = dense_bands(columns.withColumn("least", F.greatest(F.lit(120), whole(F.floor(c("pixel_width") / 5)))), 0.22, "least", ["page"], "x").hint("merge")
    x0 = F.coalesce(F.greatest(c("first") - 20, F.lit(0)), whole(c("pixel_width") * 0.08))
    x1 = F.coalesce(F.least(c("last") + 20, c("pixel_width")), whole(c("pixel_width") * 0.92))
    crop = band.join(columns, "page", "left").select("page", F.struct(F.lit("page_density_crop").alias("method"), *(x.cast("double").alias(n) for n, x in zip(CORNERS, (x0, c("y0"), x1, c("y1")), strict=True))).alias("crop")).hint("merge")
    rest = (F.lit(0), whole(c("pixel_height") * 0.16), c("pixel_width"), whole(c("pixel_height") * 0.68))
    rest = F.struct(F.lit("page_density_fallback").alias("method"), *(x.cast("double").alias(n) for n, x in zip(CORNERS, rest, strict=True)))
    found = size.join(block, "page", "left").join(area, "page", "left").join(crop, "page", "left")
    return found.select("page", F.coalesce("block", "area", "crop", rest).alias("p")).select("page", "p.*")


CORNERS = ("x0", "y0", "x1", "y1")


def pictures(files: DataFrame, read: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """path and what an injected reader finds in each file (layout blocks, areas, page texts, outlines). files: a binaryFile
    table. The reader brings its own PDF, OCR or imaging library; a file that it returns nothing for gives no row."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = read(content)
                if rows:
                    yield pa.RecordBatch.from_pylist([{"path": path} | {n: r.get(n) for n in names} for r in rows])

    return files.select("path", "content").mapInArrow(work, f"path string, {schema}")
