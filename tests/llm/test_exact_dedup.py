"""Groups of equal texts, tries, and spilling."""

import hashlib
import random
import re

import pytest

from quillgraph.llm import exact_dedup
from quillgraph.llm.exact_dedup import Patricia, exact_groups

from .sql import same


def plain(rows):
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (k, _), b in zip(rows, body, strict=True):
        keys = [x for (x, _), c in zip(rows, body, strict=True) if c == b]
        keep = min((x for x in keys if x is not None), default=None)
        out.append((k, keep, len(keys), k == keep, hashlib.sha256(b.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_sql(spark):
    assert same(exact_dedup.op2_exact_dedup(spark, "/root/testdata/sf0.01"), exact_dedup.OP2_SQL, "/root/testdata/sf0.01") == 1000


@pytest.mark.parametrize("most", [64 << 20, 2_000])
def test_edge_rows(spark, most):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a  b"), (4, "a\t\nb"), (5, "a b "), (5, "a b"), (None, "a b"), (None, "only"), (6, "x" * 5000), (7, "x" * 5000), (8, "x" * 4999 + "y")]
    rows += [(10 + k, "ab" * rng.randint(0, 30) + rng.choice("xyz ")) for k in range(300)]
    df = spark.createDataFrame([(k, t, "q", "r") for k, t in rows], "doc_id long, text string, rep string, keep_id string").repartition(3)
    assert sorted(map(tuple, exact_groups(df, most=most).collect()), key=repr) == plain(rows)
    assert exact_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1 << 30, 5_000, 300])
def test_trie(most):
    rng = random.Random(most)
    want, trie = {}, Patricia(most)
    for k in range(1500):
        text = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 3, 5, 40]))) + rng.choice([b"", b"tail" * 20])
        trie.insert(text, [k, 1, [k]])
        want.setdefault(text, []).append(k)
    got = {}
    for text, entry in trie.entries():
        assert text not in got
        got[text] = entry
    assert {t: (e[0], e[1], sorted(e[2])) for t, e in got.items()} == {t: (min(v), len(v), sorted(v)) for t, v in want.items()}


def test_bodies_leave_a_task_once(spark, monkeypatch):
    """A text that a third of all documents share, in tries that spill: one row with its bytes for each task."""
    rng = random.Random(9)
    hot = "the hot text " * 40
    rows = [(k, hot if k % 3 == 0 else hot[:260] + "".join(rng.choice("abcdef ") for _ in range(200))) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    kept = exact_dedup.written
    monkeypatch.setattr(exact_dedup, "written", lambda frame, name: seen.append(kept(frame, name)) or seen[-1])
    got = sorted(map(tuple, exact_groups(df, most=4_000).collect()), key=repr)
    assert got == plain(rows)
    once = seen[0]
    assert once.where("of is not null").count() > 100  # they did spill
    assert once.where("body is not null").groupBy("body").count().agg({"count": "max"}).first()[0] <= 3


def test_many_copies_of_one_text_in_a_small_trie():
    trie = Patricia(2_000)
    for k in range(20_000):
        trie.insert(b"x" * 50 + (b"" if k % 2 else b"%d" % (k % 50)), [k, 1, [k]])
    assert sum(e[1] for _, e in trie.entries()) == 20_000


def test_key_named_like_a_result(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "keep_id long, kept string")
    got = exact_groups(df, "keep_id", "kept")
    assert got.columns == ["keep_id", "keep_id_", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
    assert exact_groups(df.withColumnRenamed("keep_id", "KEPT_"), "KEPT_", "kept").columns[0] == "KEPT_"
