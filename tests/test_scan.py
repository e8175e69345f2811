"""Scans by ranges and pages of ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import assign, outline, scan


def data(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), k, rng.choice([None, None, rng.randint(-9, 9)])) for k in rng.sample(range(5 * n), n)]


def brute(rows, by):
    out, state = [], {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        last, total, top, low = state.get(g if by else 0, (None,) * 4)
        if v is not None:
            last, total, top, low = v, (total or 0) + v, v if top is None else max(top, v), v if low is None else min(low, v)
        state[g if by else 0] = last, total, top, low
        out.append((g, o, v, last, total, top, low))
    return sorted(out, key=lambda r: r[1])


@pytest.mark.parametrize("parts", [1, 3, 7, None])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_steps(spark, parts, by):
    rows = data((parts or 0) + len(by), 200)
    df = spark.createDataFrame(rows, "g string, o long, v long")
    steps = {f"x{k}": (kind, F.col("v")) for k, kind in enumerate(("last", "sum", "max", "min"))}
    got = scan.scanned(df, ["o"], steps, by, parts)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows, by)
    assert scan.scanned(df.limit(0), ["o"], steps, by, parts).count() == 0


def test_no_window_over_all_rows(spark):
    df = spark.range(1000).selectExpr("id", "if(id % 97 = 0, id, null) v")
    got = outline.filled_forward(df, F.col("v"), F.lit(True), "id", "f")
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all(", [_part#" in line for line in windows)  # what meets in one task is a row for each range
    assert all(r.f == r.id // 97 * 97 for r in got.collect())


@pytest.mark.parametrize("by", [[], ["book"]])
def test_pages_of_long_ranges(spark, by):
    rng = random.Random(5)
    found = [(rng.choice(["x", "y"]) if by else "x", k, f"n{k}", p) for k, p in enumerate(rng.choices(range(1, 400), k=40))] + [("x", 99, "null page", None)]
    pages = [(b, p, f"t{p}") for b in ("x", "y", None) for p in rng.sample(range(450), 200)] + [("x", None, "none"), ("x", 7, "again"), ("x", 10**9, "far"), ("x", 10**9 + 1, "beyond")]
    if not by:
        pages = [p for p in pages if p[0] == "x"]
    f = spark.createDataFrame(found, "book string, seq long, name string, page long").select(*(["book"] if by else []), "seq", "name", "page")
    p = spark.createDataFrame(pages, "book string, page long, text string").select(*(["book"] if by else []), "page", "text")
    want = []
    for b in ("x", "y"):
        own = sorted((r for r in found if r[0] == b and r[3] is not None), key=lambda r: (r[3], r[1]))
        for k, r in enumerate(own):
            last = own[k + 1][3] - 1 if k + 1 < len(own) else 10**9
            want += [(r[2], q[1], q[2]) for q in pages if q[0] == b and q[1] is not None and r[3] <= q[1] <= last]
    got = assign.pages_of(assign.ranges(f, 10**9, by or None), p, by or None)
    assert sorted(map(tuple, got.select("name", "page_no", "text").collect())) == sorted(want)
    assert set(got.columns) == {*by, "page_no", "seq", "name", "page", "first", "last", "text"}
