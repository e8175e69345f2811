"""A kept store of nodes and edges: numbered versions, each a copy-on-write of the buckets that a batch touches.

Under the store's folder lie ``data/<batch>/nodes`` and ``data/<batch>/edges``, Parquet partitioned by bucket, and
``versions/<number>``, a manifest: which batch's files hold each bucket, and the counts of the import. A node's bucket follows
from (label, name), an edge's from its two typed ends and its relation, so neither a label nor a hub fills one. A batch reads
and rewrites only the buckets that its rows fall into. Its manifest is written last, under the next free number, and never
over another: what a broken or a late writer leaves is in no manifest and so in no version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import PROPERTIES

#: Tasks that write a bucket, each a file of it.
SHARES = 4
EDGE = ["source_type", "source", "relation", "target_type", "target"]


class Conflict(RuntimeError):
    """Another writer has made the version first."""


@dataclass
class Version:
    """number; files: kind -> bucket -> batch; schemas: kind -> JSON; counts of the batch that made it."""

    number: int = 0
    buckets: int = 0
    files: dict[str, dict[str, str]] = field(default_factory=lambda: {"nodes": {}, "edges": {}})
    schemas: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


class Store:
    """The store in a folder that all executors reach. ``buckets`` is fixed by the first version."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests

    def versions(self) -> list[int]:
        """Numbers of all whole versions, in order."""
        at = self._path(f"{self.folder}/versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version's manifest, the last one's by default; an empty version if there is none."""
        known = self.versions()
        if number is None and not known:
            return Version(buckets=self.buckets)
        number = known[-1] if number is None else number
        if number not in known:
            raise ValueError(f"there is no version {number}")
        stream = self._fs.open(self._path(f"{self.folder}/versions/{number:08d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _publish(self, v: Version) -> None:
        """Writes a manifest beside and renames it to its number, which fails where that is taken."""
        draft = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(v.__dict__).encode()))
        finally:
            out.close()
        at = self._path(f"{self.folder}/versions/{v.number:08d}")
        if self._fs.exists(at) or not self._fs.rename(draft, at):
            self._fs.delete(draft, False)
            raise Conflict(f"version {v.number} is there already")

    # ---- reading

    def _rows(self, v: Version, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        """bucket and the rows of some buckets, of all by default; None if none is there."""
        files = {b: batch for b, batch in v.files[kind].items() if buckets is None or int(b) in buckets}
        if not files:
            return None
        schema = StructType.fromJson(json.loads(v.schemas[kind]))
        by_batch: dict[str, list[int]] = {}
        for b, batch in files.items():
            by_batch.setdefault(batch, []).append(int(b))
        out = None
        for batch, own in sorted(by_batch.items()):  # a scan for each batch, of the buckets that it still holds
            base = f"{self.folder}/data/{batch}/{kind}"
            rows = self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/bucket={b}" for b in own))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self, number: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes: label, name and properties; edges: typed ends and relation) of a version, the last one by default."""
        v = self.version(number)
        nodes, edges = self._rows(v, "nodes"), self._rows(v, "edges")
        if nodes is None:
            nodes = self.spark.createDataFrame([], "bucket int, label string, name string")
        if edges is None:
            edges = self.spark.createDataFrame([], "bucket int, " + ", ".join(f"{c} string" for c in EDGE))
        return nodes.drop("bucket"), edges.drop("bucket")

    def history(self) -> DataFrame:
        """version, success, failed, unmatched, touched_nodes, touched_edges (buckets) of each batch."""
        names = ["success", "failed", "unmatched", "touched_nodes", "touched_edges"]
        rows = [(n, *(self.version(n).counts[c] for c in names)) for n in self.versions()]
        return self.spark.createDataFrame(rows, "version long, " + ", ".join(f"{c} long" for c in names))

    # ---- writing

    def upsert(self, nodes: DataFrame, edges: DataFrame) -> int:
        """Takes in a batch; returns the new version's number.

        nodes: seq, label, name and properties. A node that is there takes all properties of its last row in the batch; rows with
        an empty or null label or name are left out. edges: typed ends and a relation, kept once each if both ends are nodes of the
        store with this batch; incomplete ones (an end or the relation is empty or null) are counted as failed, complete ones without
        both nodes as unmatched. Neither needs the whole store: ends are looked up in the buckets that they fall into."""
        v = self.version()
        count = v.buckets or self.buckets
        batch = uuid.uuid4().hex
        new = Version(v.number + 1, count, {k: dict(f) for k, f in v.files.items()}, dict(v.schemas))

        props = [c for c in nodes.columns if c in PROPERTIES and c != "category"]
        given = nodes.where((F.col("name") != "") & (F.col("label") != ""))
        given = given.groupBy("label", "name").agg(F.max_by(F.struct(F.lit(1).alias("_"), *props), "seq").alias("p")).select(_bucket(count, "label", "name").alias("bucket"), "label", "name", *(F.col(f"p.{c}") for c in props))
        touched_nodes = self._write(v, new, "nodes", batch, given, ["label", "name"])

        whole = F.coalesce((F.col("source") != "") & (F.col("relation") != "") & (F.col("target") != ""), F.lit(False))
        given_at = f"{self.folder}/data/{batch}/given"  # looked at three times, made once
        edges.select(*EDGE, whole.alias("whole")).write.option("compression", "zstd").parquet(given_at)
        rows = self.spark.read.schema(edges.select(*EDGE, whole.alias("whole")).schema).parquet(given_at)
        if rows.isEmpty():
            new.counts = {"success": 0, "failed": 0, "unmatched": 0, "touched_nodes": touched_nodes, "touched_edges": 0}
            self._publish(new)
            self._fs.delete(self._path(given_at), True)
            return new.number
        for k, e in enumerate(("source", "target")):
            rows = rows.withColumn(f"b{k}", _bucket(count, f"{e}_type", e))
        wanted = {r.b for r in rows.where("whole").select(F.explode(F.array("b0", "b1")).alias("b")).distinct().collect()}  # at most as many as there are buckets
        known = self._rows(new, "nodes", sorted(wanted))
        for k, e in enumerate(("source", "target")):
            ends = None if known is None else known.select(F.col("bucket").alias(f"b{k}"), F.col("label").alias(f"{e}_type"), F.col("name").alias(e), F.lit(True).alias(f"has{k}"))
            rows = rows.withColumn(f"has{k}", F.lit(False)) if ends is None else rows.join(ends, [f"b{k}", f"{e}_type", e], "left")
        both = F.coalesce(F.col("has0") & F.col("has1"), F.lit(False))
        each = rows.groupBy(*EDGE, "whole").agg(F.count("*").alias("n"), F.bool_or(both).alias("both"))
        at = f"{self.folder}/data/{batch}/checked"
        each.write.parquet(at)
        each = self.spark.read.schema(each.schema).parquet(at)
        c = each.agg(*(F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)).cast("long") for w in (F.col("whole"), ~F.col("whole"), F.col("whole") & ~F.col("both")))).head()
        kept = each.where("whole AND both").select(_bucket(count, *EDGE).alias("bucket"), *EDGE)
        touched_edges = self._write(v, new, "edges", batch, kept, EDGE)
        new.counts = {"success": c[0], "failed": c[1], "unmatched": c[2], "touched_nodes": touched_nodes, "touched_edges": touched_edges}
        self._publish(new)
        for path in (at, given_at):
            self._fs.delete(self._path(path), True)
        return new.number

    def _write(self, v: Version, new: Version, kind: str, batch: str, given: DataFrame, key: list[str]) -> int:
        """Writes the buckets that ``given`` falls into, merged with what they hold; returns how many they are."""
        touched = sorted(r.bucket for r in given.select("bucket").distinct().collect())
        if not touched:
            return 0
        old = self._rows(v, kind, touched)
        if old is not None:
            old = old.join(given.select("bucket", *key), ["bucket", *key], "left_anti")
            given = given.unionByName(old, allowMissingColumns=True)
        rows = given.repartition("bucket", F.pmod(F.shiftright(F.xxhash64(*key), 20), F.lit(SHARES)))
        rows.write.partitionBy("bucket").parquet(f"{self.folder}/data/{batch}/{kind}")
        held = StructType.fromJson(json.loads(new.schemas[kind])) if kind in new.schemas else StructType()
        have = {f.name for f in held}
        for f in given.drop("bucket").schema:
            if f.name not in have:
                held = held.add(f.name, f.dataType)
        if "bucket" not in have:
            held = held.add("bucket", "integer")
        new.schemas[kind] = held.json()
        new.files[kind] |= {str(b): batch for b in touched}
        return len(touched)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last ``keep`` versions, and batches that no version left holds: old ones and those of broken writes.
        Not to be called while another writes. Returns the deleted batches."""
        kept = self.versions()[-keep:] if keep > 0 else []
        for n in self.versions():
            if n not in kept:
                self._fs.delete(self._path(f"{self.folder}/versions/{n:08d}"), False)
        used = {b for n in kept for files in self.version(n).files.values() for b in files.values()}
        at = self._path(f"{self.folder}/data")
        found = [s.getPath() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        gone = [p for p in found if p.getName() not in used]
        for p in gone:
            self._fs.delete(p, True)
        return sorted(p.getName() for p in gone)


def _bucket(n: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
