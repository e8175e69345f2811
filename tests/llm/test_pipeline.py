"""The pipeline stage by stage against brute force, each on what the one before it kept."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillgraph.llm import quality
from quillgraph.llm.common import written

from .test_decontaminate import plain as plain_windows
from .test_line_dedup import plain as plain_lines
from .test_near_copies import near
from .test_simhash import plain_components


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, sf), name)
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_in_order(stages, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert len(corpus_pipeline.STAGES) == 5 and all(df.columns == columns for df in stages[:5])
    counts = [df.count() for df in stages]
    assert counts[0] > counts[1] == counts[2] > counts[3] > counts[4] == counts[5] > 0


def test_quality(stages, spark, sf):
    model = quality.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.scored(stages[0], model).where("score >= 0.7").collect()}
    assert set(rows(stages[1])) == good
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [k for k in rows(stages[0]) if labels.get(k) == 1]
    assert sum(k in good for k in clean) >= 0.95 * len(clean)


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = plain_lines([(k, r.source, r.text) for k, r in before.items()], 0.1, 5, stands=3, copies=False)
    assert {k: r.text for k, r in after.items()} == {k: t for k, _, t, _, _ in want}
    assert all(r.n_chars == len(r.text) and r.lang == before[k].lang for k, r in after.items())


def test_near_copies(stages):
    """The rule of the stage: five words, a similarity of 0.8."""
    texts = {k: r.text for k, r in rows(stages[2]).items()}
    found = plain_components(near(texts.items()), texts)
    assert set(rows(stages[3])) == {k for k, c in found.items() if k == c}


def test_benchmark(stages, spark, sf):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = plain_windows([(k, r.text) for k, r in rows(stages[3]).items()], bench)
    assert set(rows(stages[4])) == {r[0] for r in found if not r[5]}


def test_ids_and_run(stages, spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, got = rows(stages[4]), rows(stages[5])
    for k, r in got.items():
        ids = np.array(library.encode(docs[k].text, add_special_tokens=False).ids, "<u4")
        assert bytes(r.ids) == ids.tobytes() and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(docs[k].text.encode()).hexdigest()
    assert {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == {(k, r.ids_sha256) for k, r in got.items()}


def test_odd_rows(spark, sf):
    """Nulls in every column, empty texts, repeated rows, columns with names that stages use themselves, and no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "", "en", "s", 0), (900002, "", "en", "s", 0), (None, "a few words", None, "s", None)], docs.schema)
    more = docs.unionByName(odd).selectExpr("*", "1 AS key", "'x' AS score", "doc_id AS fingerprint", "text AS ids")
    for rows, left in ((more, 1), (more.limit(0), 0)):
        kept = written(rows, "odd")
        n = kept.count()
        for name, stage in corpus_pipeline.STAGES[:4]:
            after = written(stage(spark, kept, sf), name)
            assert after.columns == rows.columns and after.count() <= n
            assert after.select("doc_id").subtract(kept.select("doc_id")).count() == 0
            kept, n = after, after.count()
        ids = corpus_pipeline.STAGES[4][1](spark, kept, sf)
        assert ids.count() == n >= left
