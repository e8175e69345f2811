"""Benchmark windows in documents, against SQL and brute force."""

import hashlib
import random
import re

import pytest

from quillgraph.llm import decontaminate
from quillgraph.llm.decontaminate import contamination

from .sql import same

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, bench, n=10):
    cut = lambda t: WORDS.findall((t or "").translate(LOWER))
    wins = {(i, tuple(w[k : k + min(n, len(w))])) for i, t in bench if i is not None and (w := cut(t)) for k in range(len(w) - min(n, len(w)) + 1)}
    out = []
    for d, t in docs:
        w, hit, items = cut(t), set(), set()
        for i, x in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    items.add(str(i))
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_shuffled_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert same(contamination(docs, bench, broadcast_bytes=0), decontaminate.OP4_SQL, sf) == 1000


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = decontaminate.op4_decontaminate(spark, sf)
    assert same(df, decontaminate.OP4_SQL, sf) == 1000
    assert df.where("contaminated").count() > 0


def test_filter(spark, monkeypatch):
    """All shingles of the table pass and few others do; a full filter lets more pass and loses none."""
    own = [b"in %d" % k for k in range(5000)]
    others = [b"out %d" % k for k in range(20000)]
    df = spark.createDataFrame([(x,) for x in own + own[:50]], "shingle binary").repartition(3)
    held = decontaminate.bloom(df)
    assert decontaminate.may_hold(held, own).all()
    assert decontaminate.may_hold(held, others).mean() < 0.02
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 12)
    held = decontaminate.bloom(df)
    assert len(held) == 1 << 6 and decontaminate.may_hold(held, own).all()
    assert not decontaminate.may_hold(decontaminate.bloom(df.limit(0)), own).any()


@pytest.mark.parametrize("size", [1, 3])
def test_slices_have_each_shingle_once(spark, size):
    words = [b"w%d" % k for k in range(97)]
    held = decontaminate.bloom(spark.createDataFrame([(x,) for x in decontaminate.shingles_of(words, size)], "shingle binary"))
    got = [(a + k, own[k]) for a, own, at in decontaminate._sliced(words, size, held, 10) for k in at]
    assert got == list(enumerate(decontaminate.shingles_of(words, size)))
    assert list(decontaminate._sliced(words[: size - 1], size, held)) == []


@pytest.mark.parametrize(("broadcast_bytes", "bits"), [(1 << 20, 1 << 28), (0, 1 << 28), (0, 1 << 6)])
def test_both_joins(spark, monkeypatch, broadcast_bytes, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(["a", "b", "C", "d9", "É", "中文"]) for _ in range(n))
    bench = [(1, some(6)), (2, "one"), (3, "Two, words"), (4, None), (5, ""), (None, "a b"), (10, some(9)), (2, "a a a a a"), (7, "éa zz-zz")]
    docs = [(1, None), (2, ""), (3, "!!!"), (3, "one ONE"), (None, "two words"), (4, "x" * 5000), (5, "a " * 4000)] + [(k, some(rng.randint(0, 40)) + rng.choice(["", " two\nWORDS", bench[6][1], "-one"])) for k in range(6, 60)]
    d = spark.createDataFrame([(k, t, 0, "z") for k, t in docs], "doc_id long, text string, n_hit int, item string").repartition(3)
    b = spark.createDataFrame([(k, t, "z") for k, t in bench], "item_id long, text string, words string")
    assert sorted(map(tuple, contamination(d, b, window=4, broadcast_bytes=broadcast_bytes).collect()), key=repr) == plain(docs, bench, 4)
    assert contamination(d.limit(0), b, broadcast_bytes=broadcast_bytes).count() == 0
    assert contamination(d, b.limit(0), broadcast_bytes=broadcast_bytes).where("contaminated").count() == 0
