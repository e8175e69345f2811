"""The kept store: batches against one import, older versions, broken and late writers."""

import pytest

from quillgraph.plans import star
from quillgraph.sources import store
from quillgraph.sources.versions import Conflict, Store


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


EDGE = ["source_type", "source", "relation", "target_type", "target"]


def nodes_of(spark, data):
    return spark.createDataFrame(data, "seq long, label string, name string, caliber string, other string")


def edges_of(spark, data):
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in EDGE) + ", seq long")


def test_three_batches_are_one(spark, sf, tmp_path):
    n, e = star.entities(spark, sf), star.edges(spark, sf)
    kept = Store(spark, f"file://{tmp_path}/s", 8)
    for k in (0, 1, 2):
        kept.upsert(n.where(f"label <> 'Artillery' AND {k} = 0 OR label = 'Artillery' AND seq % 3 = {k}"), e.limit(0))
    for k in (0, 1, 2):
        kept.upsert(n.limit(0), e.where(f"pmod(seq, 3) = {k}"))
    nodes, edges = kept.read()
    props = ["label", "name", "caliber", "model", "page"]
    assert rows(nodes, *props) == rows(store.upserted_nodes(n), *props)
    assert rows(edges, *EDGE) == rows(store.upserted_edges(e, n), *EDGE)
    counts = kept.history().agg({"success": "sum", "failed": "sum", "unmatched": "sum"}).select("sum(success)", "sum(failed)", "sum(unmatched)").first()
    assert tuple(counts) == tuple(store.import_counts(e, n).first())


def test_only_touched_buckets_are_written(spark, tmp_path):
    kept = Store(spark, str(tmp_path), 16)
    kept.upsert(nodes_of(spark, [(k, "A", f"n{k}", str(k), "x") for k in range(200)]), edges_of(spark, []))
    kept.upsert(nodes_of(spark, [(1, "A", "n7", "new", "x"), (2, "A", "n7", None, "x"), (3, "A", "n8", "8b", None)]), edges_of(spark, []))
    assert [tuple(r) for r in kept.history().select("touched_nodes").collect()] == [(16,), (2,)]
    assert len(set(kept.version(2).files["nodes"].values())) == 2
    now = {r.name: r.caliber for r in kept.read()[0].collect()}
    assert len(now) == 200 and now["n7"] is None and now["n8"] == "8b" and now["n9"] == "9"
    before = {r.name: r.caliber for r in kept.read(1)[0].collect()}
    assert before["n7"] == "7" and before["n8"] == "8" and "other" not in kept.read()[0].columns


def test_edges_and_counts(spark, tmp_path):
    kept = Store(spark, str(tmp_path), 4)
    n = nodes_of(spark, [(1, "A", "a", "1", ""), (2, "B", "b", "2", ""), (3, "A", "", "3", ""), (4, None, "c", "3", ""), (5, "A", None, "", "")])
    e = [("A", "a", "R", "B", "b", 1), ("A", "a", "R", "B", "b", 2), ("A", "a", "R", "B", "later", 3), ("A", "a", None, "B", "b", 4), ("A", "", "R", "B", "b", 5), (None, "a", "R", "B", "b", 6), ("A", "b", "R", "B", "b", 7)]
    assert kept.upsert(n, edges_of(spark, e)) == 1
    assert tuple(kept.history().select("success", "failed", "unmatched").first()) == (5, 2, 3)
    kept.upsert(nodes_of(spark, [(1, "B", "later", "", "")]), edges_of(spark, [e[2], e[0]]))
    assert rows(kept.read()[1], *EDGE) == [e[0][:5], e[2][:5]] and rows(kept.read(1)[1], *EDGE) == [e[0][:5]]
    wider = spark.createDataFrame([(1, "A", "d", 5.0)], "seq long, label string, name string, range double")
    kept.upsert(wider, edges_of(spark, []))
    assert rows(kept.read()[0].where("label = 'A'"), "name", "caliber", "range") == [("a", "1", None), ("d", None, 5.0)]


def test_broken_and_late_writers(spark, tmp_path, monkeypatch):
    kept = Store(spark, str(tmp_path), 4)
    kept.upsert(nodes_of(spark, [(1, "A", "a", "1", "")]), edges_of(spark, []))

    def killed(self, v):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(Store, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            kept.upsert(nodes_of(spark, [(1, "A", "a", "broken", ""), (2, "A", "z", "", "")]), edges_of(spark, []))
    again = Store(spark, str(tmp_path), 9)
    assert again.versions() == [1] and rows(again.read()[0], "name", "caliber") == [("a", "1")]
    old = again.version()
    assert again.upsert(nodes_of(spark, [(1, "A", "b", "2", "")]), edges_of(spark, [])) == 2 and again.version().buckets == 4
    monkeypatch.setattr(Store, "version", lambda self, number=None: old)
    with pytest.raises(Conflict):
        again.upsert(nodes_of(spark, [(1, "A", "late", "", "")]), edges_of(spark, []))
    monkeypatch.undo()
    assert rows(again.read()[0], "name", "caliber") == [("a", "1"), ("b", "2")]
    assert len(again.vacuum(keep=1)) >= 2 and again.versions() == [2]
    assert rows(again.read()[0], "name", "caliber") == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError, match="no version 1"):
        again.read(1)


def test_empty_store(spark, tmp_path):
    kept = Store(spark, str(tmp_path))
    assert kept.read()[0].count() == 0 and kept.read()[1].count() == 0 and kept.history().count() == 0
    assert kept.upsert(nodes_of(spark, []), edges_of(spark, [])) == 1 and kept.read()[0].count() == 0


def test_edges_of_a_batch_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    schema = "source_type string, source string, relation string, target_type string, target string"
    edges = spark.createDataFrame([("A", "x", "r", "A", "y"), ("A", "x", "r", "B", "none"), ("A", "", "r", "A", "y")], schema).mapInArrow(count, schema)
    store = Store(spark, f"file://{tmp_path}/once", 2)
    store.upsert(spark.createDataFrame([(1, "A", "x"), (2, "A", "y")], "seq long, label string, name string"), edges)
    assert made.value == 3 and store.read()[1].count() == 1
    assert [(r.success, r.failed, r.unmatched) for r in store.history().collect()] == [(2, 1, 1)]
