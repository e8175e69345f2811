"""Edges from documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import match

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files_at_once: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def mention_edges(docs: DataFrame, entries: match.Dictionary, relation: str = "MENTIONS", key: str = "doc_id") -> DataFrame:
    """source, relation, target, each triple once over the whole stream; works on tables as well. The state is the triples."""
    found = docs.select(F.concat(F.lit("doc#"), F.col(key).cast("string")).alias("source"), F.lit(relation).alias("relation"), F.explode(match.matches(entries, F.col("text"))).alias("target"))
    return found.dropDuplicates(["source", "relation", "target"])


def write_edges(edges: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends new edges to Parquet files until what is there is worked off."""
    return edges.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total of tumbling windows; events later than ``late`` are left out of a stream."""
    timed = events.withWatermark("ts", late)
    rows = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")
