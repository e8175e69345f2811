"""Phrase frequencies and scores against plain loops, and the query against its SQL."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quillgraph.llm import phrases

from .sql import same


def counted(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least, top, share):
    f, n = counted(rows)
    out = []
    for lang in f:
        candidates = {p: a for p, a in f[lang].items() if a >= least and " " in p}
        found = []
        for p, a in candidates.items():
            w = p.split(" ")
            if any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= share * a for q, b in candidates.items()):
                continue
            l_r = [(f[lang][" ".join(w[:k])], f[lang][" ".join(w[k:])]) for k in range(1, len(w))]
            score, k = min((1000 * a * n[lang] // (l * r), k) for k, (l, r) in enumerate(l_r))
            found.append((-score, -a, p.encode(), a, *l_r[k], n[lang], score))
        out += [(lang, k, p.decode(), a, l, r, m, s) for k, (_, _, p, a, l, r, m, s) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def data(seed, n):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "a", "É", "é", "x\x00y", "a\x01", "中", "x y z", "q\tr", "long" * 30]
    ends = [" ", " ", " ", ". ", "\n", "\r\n", " , ", " "]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", None), (None, ""), ("fr", "one two"), ("en", "the of a the of a " * 300)]


def frame(spark, rows):
    return spark.createDataFrame([(t, k, 1, "p") for k, t in rows], "text string, lang string, n int, phrase string")


@pytest.mark.parametrize(("size", "hot", "share"), [(32 << 20, 256, 100), (500, 3, 100), (500, 256, 60), (3000, 100_000, 100)])
def test_against_loops(spark, monkeypatch, size, hot, share):
    monkeypatch.setattr(phrases, "SLICE_BYTES", size)
    monkeypatch.setattr(phrases, "TEXT_BYTES", size // 3)
    monkeypatch.setattr(phrases, "HOT", hot)
    rows = data(size + hot, 150)
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows).repartition(5), least=5, top=40, share=share).collect())
    assert got == brute(rows, 5, 40, share) and got


def test_few_buckets(spark, monkeypatch):
    """Neighbours that fall together lose nothing."""
    monkeypatch.setattr(phrases, "MIN_BITS", 11)
    monkeypatch.setattr(phrases, "MAX_BITS", 11)
    rows = data(3, 200)
    known, totals = phrases.frequencies(frame(spark, rows), least=4)
    f, n = counted(rows)
    assert {(r.lang, r.phrase): r.n for r in known.collect()} == {(k, p): c for k in f for p, c in f[k].items() if c >= 4}
    assert {r.lang: r.n for r in totals.collect()} == {k: c for k, c in n.items() if c}


def test_suffixes_end_before_rare_runs(spark, monkeypatch):
    """Frequent pairs in ever new runs leave a slice as pairs: a row for each frequent phrase, whatever the number of runs."""
    rng, seen = random.Random(5), []
    words = [f"w{k}" for k in range(10)]
    text = " ".join(rng.choice(words) for _ in range(4000))  # each pair some 40 times, each run of three some 4 times
    monkeypatch.setattr(phrases, "_prefixes", lambda suffixes, least, own=phrases._prefixes: (seen.append(suffixes.count()), own(suffixes, least))[1])
    known, _ = phrases.frequencies(frame(spark, [("en", text)]), least=20)
    f, _ = counted([("en", text)])
    assert {(r.lang, r.phrase): r.n for r in known.collect()} == {(k, p): c for k in f for p, c in f[k].items() if c >= 20}
    assert 80 <= seen[0] <= 120  # 100 pairs, not thousands of runs


@pytest.mark.parametrize("held", [1 << 18, 7])
def test_suffixes_of_slices_are_added_up(spark, monkeypatch, held):
    """A frequent phrase leaves a task once, however many slices and files the task goes through, unless it holds too many."""
    rng, seen = random.Random(6), []
    words = [f"w{k}" for k in range(10)]
    rows = [(lang, " ".join(rng.choice(words) for _ in range(100))) for _ in range(100) for lang in ("en", "de")]
    monkeypatch.setattr(phrases, "SLICE_BYTES", 500)
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "_prefixes", lambda suffixes, least, own=phrases._prefixes: (seen.append((suffixes.count(), suffixes.rdd.getNumPartitions())), own(suffixes, least))[1])
    known, _ = phrases.frequencies(frame(spark, rows).repartition(40), least=40)
    f, _ = counted(rows)
    assert {(r.lang, r.phrase): r.n for r in known.collect()} == {(k, p): c for k in f for p, c in f[k].items() if c >= 40}
    most = spark.sparkContext.defaultParallelism
    assert seen[0][1] <= most and (held < 10 or seen[0][0] <= 250 * most)  # 100 pairs of each language in each task, and a few by chance


def test_no_rows(spark):
    assert phrases.collocations(frame(spark, [("en", None)]).limit(0)).count() == 0
    assert phrases.collocations(frame(spark, [("en", None), (None, " .\n")])).count() == 0


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    row = spark.range(1).selectExpr("cast(4000000000 as decimal(19,0)) a", "cast(90000000000000 as decimal(19,0)) n")
    assert row.selectExpr("cast(a * n * cast(1000 as decimal(4,0)) as decimal(38,0)) div cast(a * a as decimal(38,0)) q").head()[0] == 4000000000 * 90000000000000 * 1000 // 4000000000**2


@pytest.mark.parametrize("at", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, at):
    assert same(phrases.op13_phrases(spark, at), phrases.OP13_SQL, at) > 20
