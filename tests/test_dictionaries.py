"""Keywords of a table in texts, against a search for each keyword."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.operators import automaton, dictionaries


def brute(texts, words):
    return {(k, w) for k, t in enumerate(texts) for w in words if w in t}


def search(texts, words):
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    row, word = automaton.found(automaton.build(words), np.frombuffer(b"".join(raw), np.uint8), ends)
    got = [(int(r), words[w]) for r, w in zip(row, word, strict=True)]
    assert len(got) == len(set(got))
    return set(got)


def test_random_words(monkeypatch):
    """Words inside words, ends of words that begin others, lanes of a few bytes, characters of one to four bytes."""
    rng = random.Random(5)
    for lane in (1, 3, 16, 512):
        monkeypatch.setattr(automaton, "LANE", lane)
        for alphabet in ("ab", "aé千😀", "abcdefgh"):
            for _ in range(40):
                some = lambda most: "".join(rng.choices(alphabet, k=rng.randint(0, most)))
                words = sorted({some(6) for _ in range(rng.randint(1, 12))} - {""})
                texts = [some(60) for _ in range(rng.randint(0, 6))]
                if words:
                    assert search(texts, words) == brute(texts, words)


def test_no_words_and_no_texts():
    assert search(["abc", ""], []) == set() and search([], ["a"]) == set() and search(["", ""], ["a"]) == set()


def test_shards_and_slices(spark, monkeypatch):
    """Any number of shards and slices gives the same rows; several names of a word, null keys, names and words."""
    monkeypatch.setattr(dictionaries, "SLICE", 10)
    words = spark.createDataFrame([("a", "he"), ("b", "she"), ("c", "he"), (None, "hers"), ("d", None), ("e", "nowhere")], "name string, word string")
    docs = spark.createDataFrame([(1, "ushers"), (1, "he"), (None, "she"), (2, None), (3, "h" * 40)], "k long, t string")
    want = {(1, "a"), (1, "b"), (1, "c"), (1, None), (None, "a"), (None, "b"), (None, "c")}
    for cells in (1, 20, 1 << 24):
        assert sorted(map(repr, map(tuple, dictionaries.matched(docs, words, "k", "t", cells).collect()))) == sorted(map(repr, want))


def test_many_keywords(spark):
    """A hundred thousand keywords from the documents' own words: each document holds its own, all of them, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    own = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("word")).where("word <> ''")
    words = own.select("word").distinct().orderBy(F.xxhash64("word")).limit(100_000).persist()
    found = dictionaries.matched(docs, words.select(F.col("word").alias("name"), "word")).persist()
    assert words.count() > 80_000 and found.count() == found.distinct().count()
    assert own.join(words, "word").select("doc_id", F.col("word").alias("name")).subtract(found).count() == 0
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.name in text[r.doc_id] for r in found.collect())
    some = [r.word for r in words.orderBy("word").limit(400).collect()]
    few = {(r.doc_id, r.name) for r in found.where(F.col("name").isin(some)).collect()}
    assert few == {(k, w) for k, t in text.items() for w in some if w in (t or "")}
