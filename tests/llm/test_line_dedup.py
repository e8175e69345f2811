"""Boilerplate lines by host, against SQL and brute force."""

import random

import corpus_pipeline
from quillgraph.llm import line_dedup
from quillgraph.llm.line_dedup import without_boilerplate

from .sql import same

SPACE = " \t\n\v\f\r"


def plain(rows, ratio, least, stands=1, copies=True):
    out = []
    for k, host, text in rows:
        texts = [t for _, h, t in rows if h == host]
        pages = [set(x.strip(SPACE) for x in (t or "").split("\n")) for t in (texts if copies else set(texts))]
        if text is None:
            out.append((k, host, None, 0, 0))
            continue
        lines = text.split("\n")
        gone = lambda x: x.strip(SPACE) != "" and host is not None and len(pages) >= least and (n := sum(x.strip(SPACE) in p for p in pages)) >= stands and n > ratio * len(pages)  # noqa: E731, B023
        kept = [x for x in lines if not gone(x)]
        out.append((k, host, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = line_dedup.op6_line_dedup(spark, sf)
    assert same(df, line_dedup.OP6_SQL, sf) == 1000
    assert df.where("n_dropped > 0").count() > 0


def test_native(spark, sf):
    plan = line_dedup.op6_line_dedup(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_edge_rows(spark):
    rng = random.Random(1)
    rows = [(1, "a", None), (2, "a", ""), (3, None, "menu\nx"), (4, None, "menu"), (5, "few", "menu\nmenu"), (5, "few", "menu"), (None, "a", "menu\nz"), (6, "a", "y" * 9000)]
    rows += [(k, rng.choice("ab"), "\n".join(rng.choice(["menu", " menu ", "", "foot\r", f"own {k}", "é"]) for _ in range(rng.randint(0, 7)))) for k in range(7, 80)]
    df = spark.createDataFrame([(k, h, t, 3, "m") for k, h, t in rows], "doc_id long, source string, text string, n_lines int, lines string")
    for most, stands, copies in ((1 << 20, 3, False), (0, 3, False), (1 << 20, 1, True)):
        got = without_boilerplate(df, ratio=0.4, min_pages=4, counts=True, broadcast_bytes=most, min_stands=stands, copies=copies)
        assert got.columns == [*df.columns, "_n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.source, r.text, r["_n_lines"], r.n_dropped) for r in got.collect()), key=repr) == plain(rows, 0.4, 4, stands, copies)
    assert without_boilerplate(df.limit(0)).count() == 0


def test_unique_lines_of_small_hosts_stay(spark):
    """A line of one page is over a tenth of 5 to 9 pages, and no boilerplate in the pipeline."""
    rows = [(100 * n + k, f"host{n}", f"menu\nline {n} {k}\nmore {n} {k}") for n in range(5, 10) for k in range(n)]
    df = spark.createDataFrame([(k, t, "en", h, 0) for k, h, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert got == {k: t.removeprefix("menu\n") for k, _, t in rows}


def test_groups_of_copies_keep_their_lines(spark):
    """Copies that fill a fifth of a host are one page of it in the pipeline; its menu still goes from all of them."""
    texts = ["menu\nthe copied article\nits second line"] * 10 + [f"menu\npage {k}" for k in range(40)] + ["", None]
    df = spark.createDataFrame([(k, t, "en", "host", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert got == {k: t and t.removeprefix("menu\n") for k, t in enumerate(texts)}
