"""Scores: held-out accuracy, calibration, independence of labels, and edge rows."""

import math
import zlib

import numpy as np
import xxhash

from quillgraph.llm import quality

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = quality.op8_quality(spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both.quality).mean() > 0.98
    assert both[both.quality == 1].predicted.mean() > 0.99
    log_loss = -np.mean(np.log(np.clip(np.where(both.quality == 1, both.score, 1 - both.score), 1e-6, 1)))
    assert log_loss < 0.08


def frame(spark):
    good, bad = "plain words in a row of text", "WORDS!! IN!! CAPITALS!! ***"
    rows = [(k, (good if k % 3 else bad) + f" {k}") for k in range(400)] + [(1000, None), (1001, ""), (1002, good * 4000), (1003, good), (1003, bad), (None, good)]
    return spark.createDataFrame([(k, t, "s", 0.5, "p") for k, t in rows], "doc_id long, text string, source string, score double, predicted string")


def test_edge_rows(spark):
    docs = frame(spark)
    labels = [(k, int(k % 3 > 0)) for k in range(400)] + [(5, 0), (None, 1), (7, None), (1003, 1), (99999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.scored(docs, model)
    assert got.columns == ["doc_id", "source", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 406 and all(0 <= r.score <= 1 for r in rows)
    right = [r.predicted == int(r.doc_id % 3 > 0) for r in rows if r.doc_id is not None and r.doc_id < 400]
    assert np.mean(right) > 0.97
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    empty = quality.fit(docs.limit(0), labels)
    assert len({r.score for r in quality.scored(docs, empty).collect()}) >= 1
    assert quality.scored(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    docs = frame(spark)
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    labels = [(k, int(k % 3 > 0)) for k in range(400)]
    turned = [(k, 1 - y if k in out else y) for k, y in labels]
    a, b = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, turned))
    assert np.array_equal(a.w1, b.w1) and a.temperature == b.temperature


def test_bounded_sample(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(400)], "doc_id long, quality int")
    assert quality.fit(docs, labels, max_train=20).w1.shape == (65, 32)


def plain_scores(texts, model):
    """Every step of a score in plain loops over words; contexts too, from all texts."""
    signs = quality._index_table().tolist()
    size, index, buckets = quality.SIZE, quality.INDEX, quality.BUCKETS

    def shape(w):
        out = []
        for b in w:
            c = "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else "a" if 97 <= b <= 122 or b >= 128 else chr(b)
            if not out or out[-1] != c:
                out.append(c)
        return "".join(out).encode("latin-1")

    def index_vector(w):
        rows = [xxhash.xxh64_intdigest(w) % index] + [xxhash.xxh64_intdigest(x, k) % index for k, x in ((1, shape(w)), (2, w[:2]), (3, w[-3:]))]
        return [signs[rows[0]][d] + 2 * signs[rows[1]][d] + signs[rows[2]][d] + signs[rows[3]][d] for d in range(size)]

    bucket = lambda w: xxhash.xxh64_intdigest(w) % buckets
    vectors, contexts = {}, {}
    for words in texts.values():
        for w in words:
            if w not in vectors:
                vectors[w] = index_vector(w)
    for words in texts.values():
        for i, w in enumerate(words):
            total = contexts.setdefault(bucket(w), [0] * size)
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    for d, x in enumerate(vectors[words[j]]):
                        total[d] += x
    unit = lambda v: [x / max(1e-6, sum(y * y for y in v) ** 0.5) for x in v]
    contexts = {b: unit(v) for b, v in contexts.items()}
    whole = {w: [a + b for a, b in zip(unit(v), contexts[bucket(w)], strict=True)] for w, v in vectors.items()}
    out = {}
    for k, words in texts.items():
        own = [whole[w] for w in words]
        n = max(1, len(own))
        x = [sum(v[d] for v in own) / n for d in range(size)]
        x += [sum(a[d] * b[d] for a, b in zip(own, own[1:], strict=False)) / n for d in range(size)] + [math.log(1 + len(own)) / 10]
        z = [min(4, max(-4, (a - m) / s)) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        hidden = [max(0, sum(z[i] * model.w1[i][h] for i in range(len(z))) + model.b1[h]) for h in range(len(model.b1))]
        logit = sum(a * b for a, b in zip(hidden, model.w2, strict=True)) + model.b2
        out[k] = 1 / (1 + math.exp(-logit / model.temperature))
    return out


def test_scores_by_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = plain_scores({r.doc_id: (r.text or "").encode().split() for r in docs.collect()}, model)
    got = {r.doc_id: r for r in quality.op8_quality(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert abs(r.score - want[k]) < 1e-3 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
