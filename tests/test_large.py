"""What grows with the input: where it runs, how often, and what is held at once."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import boxes, clean, derive, edges, evaluate, graph, lookup
from quillgraph.plans import rich, star
from quillgraph.sources import held


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_one_file_on_all_cores(spark, sf):
    assert spark.read.parquet(f"{sf}/part.parquet").rdd.getNumPartitions() == 1
    assert rich.docs(spark, sf).select("text").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_derivatives_in_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["a"] * 3, None, ["b"] * 4, [], ["c"] * 20])], names=["key", "rows"])
    assert [b.column(0).to_pylist() for b in derive.sliced(batch, 5)] == [[0, 1], [2, 3], [4]]
    assert [b.column(0).to_pylist() for b in derive.sliced(batch, 100)] == [[0, 1, 2, 3, 4]]
    assert [b.num_rows for b in derive.sliced(batch.slice(0, 0), 5)] == [0]


def test_pictures_without_broadcast(spark, sf):
    assert "Broadcast" not in plan(rich.main_picture(spark, sf))


def test_deep_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "seq long, source string, source_type string, relation string, target string, target_type string, method string, description string"
    rows = [(1, "A1", "Derivative", "DERIVED_FROM", "gun", "Artillery", "rule", ""), (2, "gun", "Artillery", "EQUIPPED_BY", "X", "Country", "rule", ""), (3, "gun", "Artillery", "DESIGNED_BY", "Y", "Institution", "rule", "")]
    deep = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    kept = clean.clean_edges(spark.createDataFrame([], schema), deep, spark.createDataFrame([("gun",)], "name string"), spark.createDataFrame([(1, "gun", "Z")], "seq long, name string, home string"))
    g = graph.build(spark.createDataFrame([(1, "gun", "Artillery")], "seq long, name string, label string"), kept, once=True)
    assert {(r.source, r.target) for r in g.edges.collect()} == {("A1", "gun"), ("gun", "X"), ("gun", "Y")}
    assert g.nodes.count() == 4 and clean.clean_entities(kept).count() == 3
    assert made.value == 3


@pytest.fixture(scope="module")
def ix(spark):
    names = ["part#1", "part#12", "part#123", "Part # 21", "n", "nn", "n_n", "中国炮", "国炮"]
    nodes = spark.createDataFrame([(k, n, "Artillery") for k, n in enumerate(names)], "seq long, name string, label string")
    edges = spark.createDataFrame([], "seq long, source string, relation string, relation_label string, target string, source_type string, target_type string, method string, description string")
    return lookup.index(graph.Graph(nodes, edges), spark.createDataFrame([], "name string, text string"))


def test_first_name_that_holds_a_question(spark, ix):
    asked = ["t#12", "#123", "rt#2", "1", "12", "t#1", "n_", "国", "炮", "art", "zz", "part#1234", "T # 21", " ", ""]
    rows = spark.createDataFrame(list(enumerate(asked)), "id long, question string")
    got = {r.id: r.name for r in lookup.find_all(ix, rows).collect()}
    want = {k: r.name for k, q in enumerate(asked) for r in graph.find(ix.graph, q).collect()}
    assert got == want and len(want) == 12


def test_find_makes_only_names(spark, sf, monkeypatch):
    made = []
    monkeypatch.setattr(lookup, "written", lambda df, name: made.append(name) or held.written(df, name))
    spark_rows = spark.createDataFrame([(1, "t#7")], "id long, question string")
    from quillgraph.plans import star
    assert lookup.find_all(lookup.index(star.build(spark, sf), star.texts(spark, sf)), spark_rows).first().name == "part#7"
    assert "entity-blocks" not in made and "edge-targets" not in made and "name-grams" not in made


def test_large_written_tables_are_not_broadcast(spark, monkeypatch):
    rows = spark.range(1000).select("id", F.lit("x").alias("x"))
    small = held.written(rows, "t")
    assert "Broadcast" in plan(spark.range(10).join(small, "id"))
    monkeypatch.setattr(held, "BROADCAST", 10)
    assert "Broadcast" not in plan(spark.range(10).join(held.written(rows, "t"), "id"))


def test_partitions_grow_with_the_files(spark, sf):
    rows = star.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    few, many = (held.dealt(rows, "l_partkey", part=n) for n in (1 << 30, 1000))
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < 50 < many.rdd.getNumPartitions()
    assert many.exceptAll(rows).count() == 0 and many.count() == rows.count()
    for df in (edges.first_wins(star.edges(spark, sf)), star.edges(spark, sf), evaluate.common(*[evaluate.triples(star.edges(spark, sf))] * 2, evaluate.RELATION)):
        assert "REPARTITION_BY_NUM" in plan(df)


def test_sets_are_compared_in_one_shuffle(spark):
    a, b = (spark.createDataFrame(rows, "source string, relation string, target string") for rows in ([("a", "r", None), ("a", "r", None), ("b", "r", "x")], [("a", "r", None), ("c", "r", "x")]))
    both, only = (f(a, b, evaluate.RELATION) for f in (evaluate.common, evaluate.only_in))
    assert [tuple(r) for r in both.collect()] == [("a", "r", None)] and [tuple(r) for r in only.collect()] == [("b", "r", "x")]
    for df in (evaluate.common(a, b, evaluate.RELATION), evaluate.only_in(a, b, evaluate.RELATION)):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_graph_of_several_looks_is_made_once(spark, sf):
    from quillgraph.plans import queries

    for name in ("edge_midpoints", "degree", "retrieve_context"):
        assert "lineitem" not in plan(queries.QUERIES[name](spark, sf))


def test_few_targets_and_candidates_are_sent_to_the_edges(spark, sf, monkeypatch):
    """Edges aren't shuffled by their few targets nor for four candidates, whatever the size of the tables."""
    from quillgraph.operators import layout, retrieve
    from quillgraph.plans import queries, star

    monkeypatch.setattr(held, "BROADCAST", 10)
    g, t = star.build(spark, sf, once=True), star.texts(spark, sf)
    chosen = spark.createDataFrame([("part#7", 9)], "name string, score long")
    assert plan(retrieve.blocks(g, t, chosen)).count("Join [source") == plan(retrieve.blocks(g, t, chosen)).count("BroadcastHashJoin [source") == 1
    assert sorted(retrieve.blocks(g, t, chosen).collect()) == sorted(retrieve.blocks(g, t, chosen, few=False).collect())
    rows = queries.edge_midpoints(g)
    assert "BroadcastHashJoin [target" in plan(rows) and rows.count() == g.edges.count()
    monkeypatch.setattr(layout, "FEW", 0)
    other = queries.edge_midpoints(g)
    assert "BroadcastHashJoin [target" not in plan(other) and rows.exceptAll(other).count() == other.exceptAll(rows).count() == 0


def test_mentions_write_no_edges(spark, sf, monkeypatch):
    from quillgraph.plans import bulk, star

    made, own = [], held.written
    for module in (graph, lookup):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(name) or own(df, name))
    got = bulk.questions_mentions(spark, sf)
    assert made == ["names"] and got.count() > 0
    a, b = star.build(spark, sf), star.build(spark, sf, once=True)
    assert a.nodes.exceptAll(b.nodes).count() == b.nodes.exceptAll(a.nodes).count() == 0


def test_nodes_without_deduplication(spark):
    """Nodes are the same whether edges of a kind go before or after, also where repeated edges name other types."""
    ent = spark.createDataFrame([(1, "a", "Artillery")], "seq long, name string, label string")
    rows = [(k, f"n{k % 3}", f"S{k % 2}", "USES_AMMO", f"n{k % 4}", f"T{k % 5}") for k in range(40, 0, -1)]
    e = spark.createDataFrame(rows, "seq long, source string, source_type string, relation string, target string, target_type string")
    a, b = (graph.build(ent, e, "full", once=once).nodes for once in (False, True))
    assert a.count() == 5 and a.exceptAll(b).count() == b.exceptAll(a).count() == 0
