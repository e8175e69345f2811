"""Token counts at every prefix, and what truncation and budget questions ask of them.

The counts come from the prefix dynamic programme of ``bpe``. Pieces of real text repeat, so a worker runs it once for each
distinct piece and stores the counts at all of the piece's prefixes. A document then costs one pass over its pieces: its
count is the sum of their last stored counts, and where a budget ends inside a piece the answer is read from the counts
stored for its prefixes. Nothing is encoded for a count, and nothing again for an answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .bpe import byte_bpe
from .common import table, unused

#: Tokens above which the registered query calls a document too long.
LIMIT = 1024


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit, fit_chars.

    fit_chars is the length in code points of the longest prefix that has at most ``limit`` tokens. Null text counts as
    empty: 0 bytes, 0 tokens, not over. Null and repeated keys pass through, a row each; other columns are not read.
    ``tokenizer`` must be readable at the same path by all executors. Narrow: no shuffle, one Arrow batch in memory."""
    schema = df.select(key).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean").add("fit_chars", "long")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            found = [bpe.measured(t.as_py(), limit) for t in batch.column(1)]
            n, fit = [f[0] for f in found], [f[1] for f in found]
            columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.col(key), whole.alias("text"), F.octet_length(whole).cast("long").alias("n_bytes")).mapInArrow(counted, schema)


def prefix_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, prefix_tokens array<int>: element i (from 0) is the exact token count of the first i code points.

    Null text counts as empty and gives [0]. The array is as long as the text plus one."""
    schema = df.select(key).schema.add("prefix_tokens", ArrayType(IntegerType()))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: each array is four times its text
                row = batch.slice(k, 1)
                counts = bpe.prefixes(row.column(1)[0].as_py())
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([counts], pa.list_(pa.int32()))], names=[f.name for f in schema])

    return df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(stored, schema)


def truncate(df: DataFrame, tokenizer: str, budget: int, text: str = "text") -> DataFrame:
    """df with ``text`` cut to its longest prefix of at most ``budget`` tokens; null stays null, all other columns stay."""
    schema, at = df.schema, df.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            texts = [t if t is None else t[: bpe.longest_fit(t, budget)] for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(cut, schema)


def with_counts_under(prefixes: DataFrame, budget: int, out: str = "fit_chars") -> DataFrame:
    """Adds to a table of ``prefix_counts`` the longest prefix within another budget, from the stored counts alone."""
    k = unused("k", prefixes)
    fits = F.filter(F.sequence(F.size("prefix_tokens") - 1, F.lit(0), F.lit(-1)), lambda i: F.get("prefix_tokens", i) <= budget)
    return prefixes.withColumn(k, F.get(fits, 0)).withColumnRenamed(k, out)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
