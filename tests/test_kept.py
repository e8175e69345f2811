"""What is kept between runs: replies, stages, scratch tables."""

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import edges
from quillgraph.sources import files, held
from quillgraph.sources.replies import Replies


def asking(log, fails=lambda p: False):
    def ask(prompts):
        with open(log, "a") as f:
            f.write("".join(f"{p}\n" for p in prompts))
        return [None if fails(p) else f"re {p}" for p in prompts]

    return ask


def calls(log):
    return sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, prompt string")


def test_asked_once(spark, tmp_path):
    kept, log = Replies(spark, f"file://{tmp_path}/r", "m"), f"{tmp_path}/log"
    rows = prompts(spark, ["a", "b", "a", None, ""])
    for _ in range(2):
        got = {r.seq: r.reply for r in kept.answered(rows, asking(log)).collect()}
        assert got == {0: "re a", 1: "re b", 2: "re a", 3: None, 4: "re "}
        assert calls(log) == ["", "a", "b"]
    kept.answered(prompts(spark, ["b", "c"]), asking(log)).collect()
    assert calls(log) == ["", "a", "b", "c"]
    Replies(spark, f"file://{tmp_path}/r", "other").answered(prompts(spark, ["c"]), asking(log)).collect()
    assert calls(log) == ["", "a", "b", "c", "c"]


def test_failures_are_tried_so_often(spark, tmp_path):
    log = f"{tmp_path}/log"
    kept = Replies(spark, f"{tmp_path}/r", "m", tries=3, rounds=2)
    rows = prompts(spark, ["a", "b"]).coalesce(1)
    for n in (2, 3, 3):
        got = {r.prompt: r.reply for r in kept.answered(rows, asking(log, lambda p: p == "a")).collect()}
        assert got == {"a": None, "b": "re b"} and calls(log) == ["a"] * n + ["b"]
    again = Replies(spark, f"{tmp_path}/r", "m", tries=9)
    assert {r.reply for r in again.answered(rows, asking(log)).collect()} == {"re a", "re b"}
    assert {(r.reply, r.failures) for r in again.rows().collect()} == {("re a", 3), ("re b", 0)}


def test_a_batch_that_raises_has_failed(spark, tmp_path):
    kept = Replies(spark, f"{tmp_path}/r", "m")

    def broken(prompts):
        raise OSError

    assert [r.reply for r in kept.answered(prompts(spark, ["a"]), broken).collect()] == [None]
    assert [r.reply for r in kept.answered(prompts(spark, ["a"]), lambda p: ["x"] * len(p)).collect()] == ["x"]


def test_model_edges_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "gun"), (2, "gun"), (3, "bad"), (4, None)], "seq long, text string")
    reply = '{"relations": [{"source": "gun", "relation": "R", "target": "t"}]}'
    log = f"{tmp_path}/log"

    def ask(prompts):
        asking(log)(prompts)
        return [reply if p == "gun" else "no JSON" for p in prompts]

    kept = Replies(spark, f"{tmp_path}/r", "m")
    for _ in range(2):
        assert [(r.seq, r.source, r.target) for r in edges.model_edges(docs, ask, kept=kept).orderBy("seq").collect()] == [([1, 0], "gun", "t"), ([2, 0], "gun", "t")]
    assert calls(log) == ["bad", "gun"]


def test_stage_is_made_again_when_its_inputs_change(spark, tmp_path):
    made = []
    path, source = f"{tmp_path}/stages/one", f"{tmp_path}/in.json"
    open(source, "w").write("1")

    def stage(n=1, **parameters):
        def make():
            made.append(n)
            return spark.range(n)

        return files.read_through(spark, path, make, [source, f"{tmp_path}/missing"], parameters).count()

    assert [stage(1), stage(2)] == [1, 1] and made == [1]
    open(source, "w").write("22")
    assert [stage(3), stage(4)] == [3, 3]
    assert [stage(5, width=2), stage(6, width=2)] == [5, 5] and made == [1, 3, 5]
    os.remove(f"{path}/_SUCCESS")  # as a write that broke off leaves it
    assert [stage(7, width=2), stage(8, width=2)] == [7, 7]
    with pytest.raises(ZeroDivisionError):
        files.read_through(spark, path, lambda: 1 / 0, [source], {"width": 3})
    assert stage(9, width=2) == 7 and os.listdir(f"{tmp_path}/stages") == ["one"]


def test_scratch_tables_have_an_owner(spark):
    kept = held.written(spark.range(3), "kept")
    with held.Scratch(spark) as outer:
        one = held.written(spark.range(4), "one")
        with held.Scratch(spark) as inner:
            two = held.written(spark.range(5), "two")
            assert two.agg(F.sum("id")).first()[0] == 10 and len(inner.paths) == 1
        assert one.count() == 4 and len(outer.paths) == 1
        paths = [*outer.paths, *inner.paths]
    assert kept.count() == 3 and not any(files.exists(spark, p) for p in paths)
