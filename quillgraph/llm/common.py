"""What the operators of this subpackage share: reading tables, the shared folder, Arrow batches as byte strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.held import shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a binary column without nulls, start of each row and the end of the last) as numpy views."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (whole[at[0] : at[-1]], at - at[0]) if len(at) else (whole[:0], np.zeros(1, np.int64))


def unused(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
