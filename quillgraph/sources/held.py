"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a written table up to which Spark may broadcast it. Files are packed, so that a few MB of them, which Spark takes for
#: small, may be hundreds in the driver's memory.
BROADCAST = 1 << 20
#: Bytes of the files that a job reads for each partition of what ``dealt`` deals out.
PART = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it.

    Where nobody has set one, a temporary folder is taken if Spark runs on one machine; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Owner of the tables that ``written`` makes inside a with block: they are deleted at its end. Frames that read them are
    of no use afterwards, so results are to be written or collected before."""

    open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch.open.remove(self)
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *keys: str, parts: int = 0, per_core: int = 4) -> DataFrame:
    """df dealt by keys over all cores and in at least ``parts``: for rows that are few bytes and much work or many rows later, which
    Spark would leave in the few partitions that their bytes ask for."""
    return df.repartition(max(parts, per_core * df.sparkSession.sparkContext.defaultParallelism), *keys)


def dealt(df: DataFrame, *keys: str, part: int = PART) -> DataFrame:
    """df dealt by keys into as many partitions as the files that it reads have times ``part`` bytes, and one for each core at least:
    what a task sorts or groups stays the same when the input grows. Rows of one key meet in one task, before any are combined."""
    paths = [df.sparkSession._jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    size = sum(p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(max(-(-size // part), df.sparkSession.sparkContext.defaultParallelism), *keys)


def written(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, and lost executors lose none of it. ``rows``: most rows of a row
    group, for rows of some MB: a task that writes or reads them holds a whole group, which by default begins to be measured at 100 rows."""
    path = f"{shared_dir(df.sparkSession)}/quillgraph/{name}-{uuid.uuid4().hex}"
    if Scratch.open:
        Scratch.open[-1].paths.append(path)
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", rows) if rows else out).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return table.hint("merge") if size > BROADCAST else table
