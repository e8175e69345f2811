"""Tables with large rows, and the tasks that read them."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq

from quillgraph.llm import alignment
from quillgraph.sources import held


def groups(path: str) -> list[int]:
    files = [pq.ParquetFile(f).metadata for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    return [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]


def test_row_groups_of_few_rows(spark):
    with held.Scratch(spark) as scratch:
        rows = held.written(spark.range(10).coalesce(1), "large-rows", rows=4)
        assert sorted(groups(scratch.paths[-1].replace("file://", ""))) == [2, 4, 4] and rows.count() == 10
        held.written(spark.range(10).coalesce(1), "small-rows")
        assert groups(scratch.paths[-1].replace("file://", "")) == [10]


def test_tasks_join_few_blocks(spark, monkeypatch):
    """As many parts as there are blocks ask for, which no adaptive plan merges."""
    import public_tokenizers

    monkeypatch.setattr(alignment, "JOINED", 1)
    docs = spark.range(40).selectExpr("id as doc_id", "concat('some words, ', id) as text").repartition(12)
    made = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "hashpartitioning(block" in plan and made.count() == 40
