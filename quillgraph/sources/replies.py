"""A model's replies, kept by prompt: what has been answered is never asked again, what has failed only so often."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, reply string"


class Replies:
    """Replies of one model in a folder that all executors reach. A row is one try; a null reply is a failure.

    ``tries``: a prompt that has failed so often is asked no more. ``rounds``: how often one call asks what has failed in it."""

    def __init__(self, spark: SparkSession, folder: str, model: str, tries: int = 3, rounds: int = 1):
        self.spark, self.folder, self.model, self.tries, self.rounds = spark, folder.rstrip("/"), model, tries, rounds

    def rows(self) -> DataFrame:
        """key, reply (null while none), failures: a row for each prompt that was asked."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        tries = self.spark.read.schema(SCHEMA).parquet(self.folder) if there else self.spark.createDataFrame([], SCHEMA)
        return tries.groupBy("key").agg(F.max("reply").alias("reply"), F.count_if(F.col("reply").isNull()).alias("failures"))

    def answered(self, prompts: DataFrame, ask: Callable[[list[str]], list[str | None]]) -> DataFrame:
        """prompts (with a column ``prompt``) and ``reply``, null where none was got. Equal prompts are asked once. ask: a batch of
        prompts to as many replies, None on failure; a batch that raises has failed as a whole. New replies are appended to the
        folder before any is used, so a job that breaks off later asks for none of them again."""
        keyed = prompts.withColumn("_key", F.sha2(F.concat_ws("\0", F.lit(self.model), F.col("prompt")), 256))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                try:
                    said = ask(texts) if texts else []
                except Exception:  # noqa: BLE001
                    said = [None] * len(texts)
                if len(said) != len(texts):
                    raise ValueError(f"{len(texts)} prompts have got {len(said)} replies")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["key", "reply"])

        distinct = keyed.where("prompt is not null").groupBy(F.col("_key").alias("key")).agg(F.first("prompt").alias("prompt"))
        for _ in range(self.rounds):
            done = self.rows().where((F.col("reply").isNotNull()) | (F.col("failures") >= self.tries)).select("key")
            new = distinct.join(done, "key", "left_anti")
            if new.isEmpty():
                break
            new.mapInArrow(asked, SCHEMA).write.mode("append").parquet(self.folder)
        return keyed.join(self.rows().select(F.col("key").alias("_key"), "reply"), "_key", "left").drop("_key")
