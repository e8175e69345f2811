"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re

import pytest

from quillgraph.llm.substring_dedup import FingerprintIndex, op9_substring_dedup, repeated_passages


def plain(rows, n=50):
    seen: dict[tuple, int] = {}
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    for k, w in words:
        if k is not None:
            for i in range(len(w) - n + 1):
                x = tuple(w[i : i + n])
                seen[x] = min(k, seen.get(x, k))
    out = []
    for k, w in words:
        gone = set()
        if k is not None:
            for i in range(len(w) - n + 1):
                if seen[tuple(w[i : i + n])] < k:
                    gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert sum(r[2] for r in want) > 0
    assert got(op9_substring_dedup(spark, sf)) == want


@pytest.mark.parametrize(("window", "gram", "batches"), [(6, 3, 1), (6, 3, 3), (5, 5, 2), (4, 1, 4)])
def test_small_windows(spark, window, gram, batches):
    rng = random.Random(window * 10 + batches)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(window, 3 * window))) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "a " * 40), (4, "a " * 3), (5, "b " * 30 + "a " * 9), (5, "b " * 30), (None, "b " * 30), (6, passages[0])]
    for k in range(7, 90):
        parts = [rng.choice([*passages, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(0, 9)))]) for _ in range(rng.randint(0, 4))]
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(parts)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, doc string, d1 int").repartition(3)
    assert got(repeated_passages(df, window=window, gram=gram, batches=batches)) == plain(rows, window)


def test_empty_and_incremental(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_passages(df).count() == 0
    first = spark.createDataFrame([(9, "one two three four five")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "zero one two three four six"), (2, "nothing of it")], "doc_id long, text string")
    index = FingerprintIndex(spark, window=4, gram=2)
    assert [r.n_removed for r in index.add(first, first).collect()] == [0]
    rows = {r.doc_id: r for r in index.add(second, first.unionAll(second), with_text=True).collect()}
    assert rows[1].kept_text == "zero six" and rows[2].n_removed == 0 and len(index.runs) == 1


def thue_morse(a, b, doublings=11):
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_and_documents_in_thue_morse_order(spark):
    """What collides under any polynomial hash modulo a power of two: words of such letters, documents of such words."""
    t, c = thue_morse("a", "b")
    tail = " ".join(f"w{k}" for k in range(60))
    x, y = thue_morse("one ", "two ")
    rows = [(1, f"{t} {tail}"), (2, f"{c} {tail}"), (3, f"{t} " * 60), (4, f"{c} " * 60), (5, x), (6, y), (7, f"{t} " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert [r[2] for r in want][:4] == [0, 60, 0, 0]
    assert got(repeated_passages(df)) == want


def test_hot_grams(spark):
    """A passage that stands in two thirds of all documents, with other words around it and as part of longer repeats."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, " ".join([f"a{rng.randrange(9)}", passage, *(f"b{rng.randrange(3)}" for _ in range(4)), f"c{k}"])) if k % 3 else (k, f"own {k} " * 9) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, 8)
    for batches in (1, 3):
        assert got(repeated_passages(df, window=8, gram=4, batches=batches, hot=5)) == want


def test_index_is_taken_up_again(spark, tmp_path):
    """Each batch by an index that was opened anew, from the manifest alone; replaced runs are gone."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30)))) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path, out = f"file://{tmp_path}/index", []
    for k in range(4):
        index = FingerprintIndex(spark, window=7, gram=3, path=path, hot=6) if k == 0 else FingerprintIndex.open(spark, path)
        out += got(index.add(df.where(f"doc_id >= {20 * k} and doc_id < {20 * k + 20}"), df.where(f"doc_id < {20 * k + 20}")))
        for run in index.runs:
            spark.sql(f"DROP TABLE {run.places}")  # another session's catalogue does not know them
            spark.sql(f"DROP TABLE {run.wholes}")
    assert sorted(out, key=repr) == plain(rows, 7)
    assert len(index.runs) == 1 and len(list((tmp_path / "index").glob("wholes_*"))) == 1 and len(list((tmp_path / "index").glob("grams_*"))) == 1


def test_one_gram_in_a_third_of_all_documents(spark):
    rng = random.Random(9)
    hot = " ".join(f"h{k}" for k in range(60))
    rows = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(20)) + (f" {hot}" if k % 3 == 0 else "")) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r[0]: r for r in plain(rows)}
    assert sum(r[2] for r in want.values()) >= 999 * 60
    assert got(repeated_passages(df, hot=50)) == sorted(want.values(), key=repr)
