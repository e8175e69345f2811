"""Site-relative removal of boilerplate lines, with DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that contain it exceeds a ratio. The lines of a page are
compared without the white space around them, by XXH64 and length; each page counts once for a line, and equal pages of a host
count as one, in the line's count and in the host's total, so that a group of copies is no boilerplate. A line must also stand
on ``MIN_STANDS`` different pages. Counting shuffles a row for each different (host, page, line) of a task, keyed by all three,
then a sum for each (host, line) of a task, so neither a host that has a third of all pages nor a line that stands on all
of them makes a large group.

The lines over the ratio come back to the pages as one array for each host. Such an array is short by construction: each
of its lines stands on more than ``ratio`` of the host's pages, so there are fewer than (lines of an average page) / ratio.
The arrays are written and measured. Up to a fixed number of bytes they are broadcast and pages do not move; beyond it
pages find their host's array in a join on host and a salt that is a hash of the page, the arrays being repeated for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, unused, written

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.1
#: Hosts with fewer pages keep their lines: a share of a few pages says nothing.
MIN_PAGES = 5
#: Pages on which a line must stand besides the ratio, so that no page's own line is boilerplate of a small host.
MIN_STANDS = 3
SALTS = 64
#: Bytes of boilerplate arrays up to which they are broadcast.
BROADCAST_BYTES = 8 << 20

_SPACE = " \t\n\v\f\r"


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def _hash(line: Column) -> Column:
    """Of a bare line; null for one without content, which is never boilerplate."""
    return F.when(line != "", F.xxhash64(line, F.length(line)))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, min_stands: int = MIN_STANDS, copies: bool = False) -> DataFrame:
    """host, lines (sorted array of hashes): what exceeds the ratio and stands on ``min_stands`` pages, on each host that has
    such lines. Without ``copies``, pages of one host with equal texts (by XXH64 and length) are one page in all counts."""
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text")).where(F.col("host").isNotNull())
    if not copies:
        pages = pages.withColumn("own", F.struct(F.xxhash64("text"), F.length("text")))
    one = pages if copies else pages.select("host", "own").distinct()
    totals = written(one.groupBy("host").agg(F.count("*").alias("pages")), "pages")
    if totals.agg(F.coalesce(F.sum(64 + F.octet_length("host")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        totals = F.broadcast(totals)  # else a host's lines meet in the join, which splits large hosts
    own = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: _hash(_bare(x))))
    stands = pages.select(*(c for c in pages.columns if c != "text"), F.explode(own).alias("line")).where("line is not null")
    counted = (stands if copies else stands.distinct()).groupBy("host", "line").agg(F.count("*").alias("n"))
    over = counted.where(F.col("n") >= min_stands).join(totals, "host").where((F.col("pages") >= min_pages) & (F.col("n") > F.lit(ratio) * F.col("pages")))
    return over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def without_boilerplate(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False, broadcast_bytes: int = BROADCAST_BYTES, min_stands: int = MIN_STANDS, copies: bool = False) -> DataFrame:
    """The rows of df with boilerplate lines taken out of ``text``; other lines and their order stay, joined by \\n.

    With ``counts``, two columns follow: n_lines and n_dropped (both 0 for null text). Null text stays null and counts as a
    page of its host; a text of which all lines go is empty. Pages with a null host, and those of hosts with fewer than
    ``min_pages`` pages, keep all lines, and so does a line on fewer than ``min_stands`` pages of its host. Rows
    that repeat a key are pages of their own; without ``copies``, equal texts of a host are one page. All other columns stay."""
    found = written(boilerplate(df, host, text, ratio, min_pages, min_stands, copies), "boilerplate")
    n_bytes = found.agg(F.coalesce(F.sum(64 + F.octet_length("host") + 8 * F.size("lines")), F.lit(0))).first()[0]
    page, line = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("page"), F.struct(*found.columns).alias("found")
    own, theirs = F.col(f"page.`{host}`"), F.col("found.host")
    if n_bytes <= broadcast_bytes:
        joined = df.select(page).join(F.broadcast(found.select(line)), own == theirs, "left")
    else:
        salt = F.pmod(F.xxhash64(F.col(f"page.`{text}`"), F.col(f"page.`{key}`")), F.lit(SALTS)).cast("int")
        salted = found.select(line, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("to"))
        joined = df.select(page).withColumn("salt", salt).join(salted, (own == theirs) & (F.col("salt") == F.col("to")), "left")
    whole = F.col(f"page.`{text}`")
    split = joined.select("page", "found", F.split(whole, "\n").alias("every"))
    goes = lambda x: F.coalesce(F.array_contains("found.lines", _hash(_bare(x))), F.lit(False))
    cut = split.withColumn("kept", F.when(F.col("found").isNull(), F.col("every")).otherwise(F.filter("every", lambda x: ~goes(x))))
    clean = F.when(F.size("kept") == F.size("every"), whole).otherwise(F.array_join("kept", "\n"))
    out = [clean.alias(c) if c == text else F.col(f"page.`{c}`") for c in df.columns]
    if counts:
        n_lines = F.when(whole.isNull(), 0).otherwise(F.size("every")).cast("long")
        n_dropped = F.when(whole.isNull(), 0).otherwise(F.size("every") - F.size("kept")).cast("long")
        out += [n_lines.alias(unused("n_lines", df)), n_dropped.alias(unused("n_dropped", df))]
    return cut.select(*out)


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs, counts=True)


OP6_SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
     b AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare FROM l),
     t AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source),
     o AS (SELECT source, bare FROM b WHERE bare <> '' GROUP BY source, bare HAVING count(DISTINCT text) >= 3 AND count(DISTINCT text) > 0.1 * (SELECT pages FROM t WHERE t.source = b.source)
           AND (SELECT pages FROM t WHERE t.source = b.source) >= 5),
     f AS (SELECT b.*, o.bare IS NOT NULL AS gone FROM b LEFT JOIN o USING (source, bare)),
     g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS clean FROM f GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE g.clean END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN g USING (doc_id)
"""
