"""Context blocks read back into cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.text import stripped


def intro(answer: Column) -> Column:
    """What stands before the first block, its lines stripped and run together."""
    lines = F.split(answer, "\n")
    head = F.aggregate(lines, F.struct(F.lit("").alias("text"), F.lit(False).alias("on")), lambda a, x: F.struct(F.when(a["on"] | x.startswith(v.BLOCK), a["text"]).otherwise(F.concat(a["text"], stripped(x))).alias("text"), (a["on"] | x.startswith(v.BLOCK)).alias("on")))
    return head["text"]


def cards(answers: DataFrame, key: str = "id", answer: str = "answer") -> DataFrame:
    """key, card, title, facts, relations, excerpt of each block of an answer. A line that starts a block opens the next card;
    a field without content gives an empty array or text."""
    blocks = F.slice(F.split(F.concat(F.lit("\n"), F.col(answer)), f"\n{v.BLOCK}"), 2, 1 << 20)
    rows = answers.select(F.col(key), F.posexplode(blocks).alias("card", "block"))
    lines = F.split("block", "\n")
    field = lambda mark: F.coalesce(F.get(F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: F.substring(x, len(mark) + 1, 1 << 30)), -1 + F.greatest(F.size(F.filter(lines, lambda x: x.startswith(mark))), F.lit(1))), F.lit(""))
    items = lambda x: F.when(x == v.NOTHING, F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(x, "；"), stripped), lambda p: p != ""))
    text = field(v.BLOCK_TEXT)
    return rows.select(key, "card", stripped(F.get(lines, 0)).alias("title"), items(field(v.BLOCK_FACTS)).alias("facts"), items(field(v.BLOCK_RELATIONS)).alias("relations"), F.when(text == v.NOTHING, "").otherwise(text).alias("excerpt"))
