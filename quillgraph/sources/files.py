"""Stage files: JSON objects with names as keys, read by explicit schemas, with fallbacks and read-through."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def first_of(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there. Views of the trusted graph prefer the clean file, the store's import the raw one."""
    return next((p for p in paths if exists(spark, p)), None)


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: the fields of a JSON object that fills the file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_map(spark: SparkSession, path: str | None, key: str = "name", value: str = "text") -> DataFrame:
    """key, value of a JSON object from strings to strings; no rows without a file."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], f"{key} string, {value} string")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.PAGE_FILE).alias("m"))
    return whole.select(F.explode("m").alias(key, value))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page, text of an OCR cache, whose keys are page numbers as strings."""
    return read_map(spark, path, "page", "text").withColumn("page", F.col("page").cast("int"))


def read_records(spark: SparkSession, path: str, field: str, schema: str = schemas.EXTRACT_FILE) -> DataFrame:
    """seq and the fields of an array of records in a stage file, in order."""
    rows = read_object(spark, path, schema).select(F.posexplode(field).alias("seq", "r"))
    return rows.select(F.col("seq").cast("long").alias("seq"), "r.*")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """label, name of a graph file."""
    return read_object(spark, path, schemas.GRAPH_FILE).select(F.explode("entities").alias("label", "names")).select("label", F.explode("names").alias("name"))


def fingerprint(spark: SparkSession, inputs: list[str], parameters: dict | None = None) -> str:
    """Digest of all files under the inputs (path, size, time) and of parameters; a missing input counts as such."""
    conf, seen = spark._jsc.hadoopConfiguration(), []
    for path in inputs:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            seen.append((path, None, None))
            continue
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(seen, key=str), parameters or {}], sort_keys=True, default=str).encode()).hexdigest()


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: list[str] | None = None, parameters: dict | None = None) -> DataFrame:
    """The table at path. It is made where none is, where its write has not ended, and where it was made of other inputs or by
    other parameters than these: beside it, with their fingerprint in it, and renamed when all is written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, now = at.getFileSystem(spark._jsc.hadoopConfiguration()), fingerprint(spark, inputs or [], parameters)
    if not (exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{path}/_made_of_{now}")):
        draft = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        make().write.parquet(draft)
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{draft}/_made_of_{now}"), True).close()
        fs.delete(at, True)
        fs.mkdirs(at.getParent())
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(draft), at):
            raise OSError(f"{draft} could not be renamed to {path}")
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)
