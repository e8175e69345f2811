"""Formatted conversations, read back, against SQL and brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat

from .sql import same


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    df = chat.op5_chat(spark, sf)
    assert same(df, chat.OP5_SQL, sf) > 10
    assert df.where("n_windows > 1").count() > 0


def test_native(spark, sf):
    plan = chat.op5_chat(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def rows():
    rng = random.Random(3)
    parts = ["\\", "###", "</turn>", ":", ": ", "\\s", "\\e", "#", "<", " </turn>\n", "### user: ", "é😀", "word ", "\n"]
    out = [(1, 0, "system", "be brief"), (2, None, "user", "null turn"), (2, 3, None, None), (2, 3, "assistant", ""), (None, 1, "assistant", "no conversation"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (4, 0, "a:b\\###", "x")]
    for k in range(1, 60):
        out.append((1, k, rng.choice(["user", "assistant"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))))
    out.append((1, 60, "assistant", "long " * 3000))
    out += [(5, t * 500, "user" if t % 2 else "assistant", f"turn {t}") for t in range(40)]
    return out


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows()], "conv_id long, turn long, role string, text string, body string, n int").repartition(3)
    parts = chat.windows(df, budget=60, history=20)
    got = {r.conv_id: r for r in chat.read_back(chat.training_texts(parts)).collect()}
    by: dict = {}
    for c, t, role, text in rows():
        by.setdefault(c, []).append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        r = got[c]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    texts = chat.training_texts(parts).where("conv = 1").orderBy("window").collect()
    head = "### system: be brief </turn>\n"
    assert len(texts) > 5 and all(t.formatted.startswith(head) or "long long" in t.formatted for t in texts)
    assert any(t.n_repeated > 1 for t in texts)
    assert chat.read_back(chat.training_texts(chat.windows(df.limit(0)))).count() == 0


def plain_windows(sizes, system, budget, history):
    """(first own turn, turns repeated, whether the system turn is) of each window, by the rule, and its own turns."""
    out = []
    for i, x in enumerate(sizes):
        if i % 1024 and out[-1][3] + x <= budget:
            out[-1][3] += x
            out[-1][4].append(i)
            continue
        kept = system and i > 0 and sizes[0] + x <= budget
        used, back = x + (sizes[0] if kept else 0), 0
        room, j = min(history, budget - used), i - 1
        while j >= max(i - 128, i // 1024 * 1024, 1 if system else 0) and sizes[j] <= room:
            room, used, back, j = room - sizes[j], used + sizes[j], back + 1, j - 1
        out.append([i, back, kept, used, [i]])
    return out


@pytest.mark.parametrize(("budget", "history", "system"), [(50, 6, False), (30, 10, True), (9, 4, True)])
def test_budget(spark, budget, history, system):
    rng = random.Random(budget)
    sizes = [rng.choice([1, 2, 3, 4, 20]) for _ in range(2_100)]
    rows = [("c", k, "system" if system and not k else rng.choice(["user", "assistant"]), f"t{k}", n) for k, n in enumerate(sizes)]
    parts = chat.windows(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, size int"), tokens="size", budget=budget, history=history)
    got: dict = {}
    for r in parts.collect():
        got.setdefault(r.window, []).append((r.kind, r.n, r.tokens, r.loss))
        assert r.loss == (r.kind == 2 and rows[r.n][2] == "assistant")
    want = {first: sorted([(2, i) for i in own] + [(1, first - k) for k in range(1, back + 1)] + [(0, 0)] * kept) for first, back, kept, _, own in plain_windows(sizes, system, budget, history)}
    assert {w: sorted((k, n) for k, n, _, _ in turns) for w, turns in got.items()} == want
    assert all(sum(t for _, _, t, _ in turns) <= budget or len(turns) == 1 for turns in got.values())
    assert any(k == 1 for turns in got.values() for k, *_ in turns)


def test_no_window_over_the_budget(spark):
    """Over a whole table, with all that is repeated counted."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    sums = chat.windows(turns).groupBy("conv", "window").agg(F.sum("tokens").alias("sum"), F.count("*").alias("n"))
    assert sums.count() > 0 and sums.where(f"sum > {chat.BUDGET} and n > 1").count() == 0


def test_keys_and_numbers_of_other_kinds(spark):
    """String keys; turns that are all null or all equal are ordered by role and text; equal rows stay."""
    rows = [("a", None, r, t) for r, t in [("user", "b"), ("user", "a"), ("assistant", "c"), ("assistant", "c")]] + [("b", 5, "user", f"{k:04}") for k in range(1500)] + [(None, 1, "assistant", "none")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.training_texts(chat.windows(df))).collect()}
    for key in ("a", "b", None):
        turns = sorted((r, t) for k, _, r, t in rows if k == key)
        assert got[key].n_turns == len(turns) and got[key].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert len(got) == 3
