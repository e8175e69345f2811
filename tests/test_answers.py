"""Answers in bulk against the answer to each question."""

import random

import pytest

from quillgraph import vocabulary as v
from quillgraph.functions import text
from quillgraph.operators import answers, lookup, retrieve
from quillgraph.plans import rich


@pytest.fixture(scope="module")
def g(spark, sf):
    return rich._graph(spark, sf)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return rich.docs(spark, sf).select("name", "text")


@pytest.fixture(scope="module")
def ix(g, texts):
    return lookup.index(g, texts, block=50)


def some(n):
    rng = random.Random(n)
    name = lambda entries: rng.choice(entries)[0]
    out = [*rich.QUESTIONS.values(), None, "", "\x1c 　", "哪些", "R7火炮", "r 7火炮", "R7A", "榴弹炮", "德国", "zz", "developed", " 二战有哪些火炮 "]
    for _ in range(n):
        parts = [name(v.WARS), name(v.INSTITUTIONS), name(v.CHASSIS), name(v.NATIONS), "哪", "哪些", "口径最大", "最大口径", "研制", "研发", "Developed", f"R{rng.randint(1, 220)}火炮", "的", " "]
        out.append("".join(rng.sample(parts, rng.randint(1, 4))))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(str(k), q) for k, q in enumerate(texts)], "id string, question string")


def test_answers_are_those_of_each(spark, g, ix):
    asked = some(40)
    got = {r.id: r.answer for r in answers.answers(ix, frame(spark, asked)).collect()}
    assert got == {str(k): retrieve.answer(g, q or "") for k, q in enumerate(asked)}
    assert answers.answers(ix, frame(spark, ["x"]).limit(0)).count() == 0


def test_with_context(spark, g, ix, texts):
    asked = ["zz", "", None, "R7火炮", "二战中哪些火炮由克虏伯设计？", "the R7火炮 and R8火炮 and 高爆弹", "基于M4谢尔曼底盘的火炮，口径最大的是什么"]
    got = {r.id: r.asDict() for r in answers.answers_with_context(ix, texts, frame(spark, asked)).collect()}
    for k, q in enumerate(asked):
        assert {x: got[str(k)][x] for x in ("answer", "sources", "used_model", "is_relevant")} == retrieve.answer_with_context(g, texts, q or "")
    assert any(r["answer"].startswith(v.ONLY_FOUND) for r in got.values())
    replies = lambda qs, cs: [f"{q}|{len(c)}|{c[0][:9]}" for q, c in zip(qs, cs, strict=True)]
    got = {r.id: r.asDict() for r in answers.answers_with_context(ix, texts, frame(spark, asked), replies).collect()}
    for k, q in enumerate(asked):
        want = retrieve.answer_with_context(g, texts, q or "", lambda q, c: f"{q}|{len(c)}|{c[0][:9]}")
        assert {x: got[str(k)][x] for x in want} == want


def test_numbers_as_g(spark):
    rng = random.Random(1)
    values = [0.0, 155.0, 122.5, 1e6, 999999.5, 999999.4, 1e-4, 0.00012345678, 1e-5, -3.25, 1234567.0, 100000.0, 0.1, 12345.678, 1e20, 2.5e-7] + [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 9) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", text.general(__import__("pyspark").sql.functions.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.x:g}" for r in got]
