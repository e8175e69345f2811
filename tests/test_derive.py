"""Derivative tables of many texts at once, against those of each line by line."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgraph import vocabulary as v
from quillgraph.functions import text
from quillgraph.operators import derive

LINES = ["M1", "M1A1", "12", "1234", "12345", "٣", "²", "改进型", "改进型号A", "A改进型号", "第3页", "Chapter 2", "第", "版A", "x" * 30, "x" * 31, "-", "a  b", "a　　b c", "a\x1c\x1fb", "a\tb\tc", "全球火炮 A", "型号", "特点", v.SECTION, "", "  ", " B\r", "\x1cC\x1c", " D\x85", "b c", "日本語"]


def made(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", "no table", v.SECTION, f"{v.SECTION}\n型号\n特点", f"x{v.SECTION}{v.SECTION_ENDS[0]}", f"{v.SECTION}12345{v.SECTION_ENDS[1]}M1"]
    for _ in range(n):
        rows = "\n".join(rng.choice(LINES) for _ in range(rng.randrange(12)))
        out.append(rng.choice(["", "head "]) + rng.choice([v.SECTION + "\n型号\n特点\n", v.SECTION, "\n"]) + rows + rng.choice(["", "\n" + rng.choice(v.SECTION_ENDS) + " M9\nM8"]))
    return out


def test_tables_of_many_texts(spark):
    texts = made(1500, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lines = {r.id: r.rows for r in df.select("id", text.lines(text.section(F.col("text"))).alias("rows")).where("rows is not null").collect()}
    want = sorted((k, n, *row) for k, rows in lines.items() for n, row in enumerate(derive.table_rows(rows)))
    at, n, name, note = derive.tables(texts)
    assert sorted(zip(at.tolist(), n.tolist(), name.to_pylist(), note.to_pylist(), strict=True)) == want and len(want) > 1000
    assert len(derive.tables([])[0]) == len(derive.tables([None, "x"])[0]) == 0


@pytest.mark.parametrize("most", [1, 1 << 20])
def test_texts_are_cut_once_and_not_in_the_plan(spark, monkeypatch, most):
    monkeypatch.setattr(derive, "BYTES", most)
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(x):
        asked.add(1)
        return f"{v.SECTION}\nM{x}\n改进型号"

    df = spark.range(20).select("id", body("id").alias("text"))
    assert sorted(map(tuple, derive.derivatives(df, "id").collect())) == [(k, 0, f"M{k}", "改进型号") for k in range(20)]
    assert asked.value == 20
