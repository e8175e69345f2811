"""Answers to any number of questions in one plan; each equals what ``retrieve.answer`` says to it alone.

What a question mentions picks its intent as a column. Each intent's facts are worked out once for what was asked (a war and
a maker, a chassis, a war, a country, a node), cut to the few that an answer names, and joined back to the questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import vocabulary as v
from ..functions import text
from ..sources.held import written
from . import lookup, retrieve
from .lookup import Index

#: Names that an answer lists: of both a war and a maker, of one thing; edges of a node in each direction.
OF_TWO, OF_ONE, OF_NODE = 12, 15, 6


def said(template: str, **columns: Column) -> Column:
    """A template with its fields filled in by columns; a field of kind g is a number."""
    parts = []
    for literal, field, kind, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if field is not None:
            parts.append(text.general(columns[field]) if kind == "g" else columns[field])
    return F.concat(*parts)


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def intents(ix: Index, questions: DataFrame) -> DataFrame:
    """id, q (stripped), intent, and the first name that it mentions of each label that an intent asks for: war, maker, ride, land.
    questions: id (unique), question; null is empty."""
    rows = questions.select("id", stripped(F.coalesce("question", F.lit(""))).alias("q"))
    labels = {"war": "War", "maker": "Institution", "ride": "Chassis", "land": "Country"}
    names = ix.names.where(F.col("label").isin(*labels.values()) & (F.col("own") != "")).withColumnRenamed("own", "needle")
    found = lookup.contained(rows.select("id", text.normalised_name(F.col("q")).alias("q")), names.select("needle")).join(names, "needle")
    first = found.groupBy("id").agg(*(F.min(F.when(F.col("label") == x, F.col("name"))).alias(c) for c, x in labels.items()))
    rows = rows.join(first, "id", "left")
    has = lambda c: F.col(c).isNotNull()
    with_ = lambda *words: F.greatest(*(F.contains("q", F.lit(w)) for w in words), F.lit(False))
    intent = (
        F.when(F.col("q") == "", "ask").when(has("war") & has("maker") & with_("哪"), "both").when(has("ride") & with_("口径最大", "最大口径"), "largest")
        .when(has("war") & with_("哪些"), "war").when(has("land") & (with_("研制", "研发") | F.contains(F.lower("q"), F.lit("developed"))), "land").otherwise("node")
    )
    return rows.withColumn("intent", intent)


def _first(rows: DataFrame, keys: list[str], k: int, order: str, item: str) -> DataFrame:
    """keys, items: the first ``k`` of each group, by order; more than that never meet in a row."""
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("place") <= k)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item]).alias("items"))


def answers(ix: Index, questions: DataFrame, metric: str = "caliber", unit: str = v.UNIT) -> DataFrame:
    """id, answer. questions: id (unique), question."""
    asked = written(intents(ix, questions), "asked")  # each intent looks at it
    nodes, edges = ix.graph.nodes, ix.graph.edges
    own = ix.names.where(F.col("label") == ix.label).select(F.col("name").alias("source")).distinct()
    of = lambda relation, name: edges.where(F.col("relation") == relation).select("source", F.col("target").alias(name)).distinct().join(own, "source", "left_semi")
    wanted = lambda intent, *c: asked.where(F.col("intent") == intent).select(*c).distinct()

    both = wanted("both", "war", "maker").join(of("PARTICIPATED_IN", "war"), "war").join(of("DESIGNED_BY", "maker"), ["source", "maker"], "left_semi")
    both = _first(both, ["war", "maker"], OF_TWO, "source", "source").withColumnRenamed("items", "of_two")
    wars = _first(wanted("war", "war").join(of("PARTICIPATED_IN", "war"), "war"), ["war"], OF_ONE, "source", "source").withColumnRenamed("items", "of_war")
    lands = _first(wanted("land", "land").join(of("DEVELOPED_IN", "land"), "land"), ["land"], OF_ONE, "source", "source").withColumnRenamed("items", "of_land")
    value = text.number(F.replace(F.col(metric).cast("string"), F.lit(unit))) if metric in nodes.columns else F.lit(None).cast("double")
    sized = nodes.select(F.col("name").alias("source"), value.alias("value")).where("value is not null")
    ridden = wanted("largest", "ride").join(of("USES_CHASSIS", "ride"), "ride").join(sized, "source")
    ridden = ridden.groupBy("ride").agg(F.min(F.struct((-F.col("value")).alias("less"), "source", "value")).alias("top"))

    found = lookup.find_all(ix, asked.where("intent = 'node'").select("id", F.col("q").alias("question"))).withColumnRenamed("name", "node")
    found = written(found, "found")
    known = found.select("node").distinct()
    out = edges.join(known, F.col("source") == F.col("node")).select("node", "seq", F.concat("relation_label", F.lit(" -> "), "target").alias("edge"))
    back = edges.join(known, F.col("target") == F.col("node")).select("node", "seq", F.concat("source", F.lit(" -> "), "relation_label").alias("edge"))
    out, back = (_first(df, ["node"], OF_NODE, "seq", "edge").withColumnRenamed("items", c) for df, c in ((out, "out"), (back, "back")))

    rows = asked.join(both, ["war", "maker"], "left").join(wars, "war", "left").join(lands, "land", "left").join(ridden, "ride", "left").join(found, "id", "left").join(out, "node", "left").join(back, "node", "left")
    joined = lambda c: F.array_join(c, "；")
    war, maker, ride, land, node = map(F.col, ("war", "maker", "ride", "land", "node"))
    local = F.concat_ws(" ", F.when(F.col("out").isNotNull(), F.concat(F.lit(f"{v.OUT}: "), joined("out"))), F.when(F.col("back").isNotNull(), F.concat(F.lit(f"{v.IN}: "), joined("back"))))
    is_ = lambda intent: F.col("intent") == intent
    answer = (
        F.when(is_("ask"), v.ASK)
        .when(is_("both"), F.coalesce(said(v.BOTH, war=war, maker=maker, names=joined("of_two")), said(v.NOT_BOTH, war=war, maker=maker)))
        .when(is_("largest"), F.coalesce(said(v.LARGEST, ride=ride, name=F.col("top.source"), value=F.col("top.value")), said(v.NO_LARGEST, ride=ride)))
        .when(is_("war"), F.coalesce(said(v.OF_WAR, war=war, names=joined("of_war")), said(v.NOT_OF_WAR, war=war)))
        .when(is_("land"), F.coalesce(said(v.OF_COUNTRY, country=land, names=joined("of_land")), said(v.NOT_OF_COUNTRY, country=land)))
        .when(F.col("out").isNotNull() | F.col("back").isNotNull(), said(v.LOCAL, name=node, edges=local))
        .otherwise(v.UNSUPPORTED)
    )
    return rows.select("id", answer.alias("answer"))


def contexts(ix: Index, texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """id, name, score, context of the rows of ``lookup.candidates``: each entity's context is made once, however many questions
    it is shown to."""
    blocks = retrieve.blocks(ix.graph, texts, chosen.select("name").distinct().withColumn("score", F.lit(0)), few=False).drop("score")
    return chosen.join(blocks, "name").select("id", "name", "score", "context")


def answers_with_context(ix: Index, texts: DataFrame, questions: DataFrame, model: Callable[[list[str], list[list[str]]], list[str]] | None = None) -> DataFrame:
    """id, answer, sources, used_model, is_relevant of each question. model: (questions, their contexts) to answers, called with a
    batch of relevant questions at a time in the tasks; without it the graph answers, and where it cannot, two contexts are
    shown."""
    rows = questions.select("id", stripped(F.coalesce("question", F.lit(""))).alias("question"))
    chosen = written(lookup.candidates(ix, rows), "chosen")
    relevant = lookup.relevance(ix, rows, chosen).select("id", "is_relevant")
    shown = contexts(ix, texts, chosen).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "name", "context"))).alias("shown"))  # four at most, but for repeated texts
    rows = rows.join(relevant, "id").join(shown, "id", "left").withColumn("is_relevant", F.col("is_relevant") & (F.col("question") != ""))
    empty = F.array().cast("array<string>")
    took = lambda c: F.when(F.col("is_relevant"), F.coalesce(F.transform("shown", lambda x: x[c]), empty)).otherwise(empty)
    rows = rows.select("id", "question", "is_relevant", took("name").alias("sources"), took("context").alias("contexts"))
    if model is None:
        rows = rows.join(answers(ix, rows.select("id", "question")), "id")
        fallback = F.concat(F.lit(v.ONLY_FOUND), F.array_join(F.slice("contexts", 1, 2), "\n\n"))
        answer = F.when(F.col("question") == "", v.ASK).when(~F.col("is_relevant"), v.IRRELEVANT).when(F.col("answer") == v.UNSUPPORTED, fallback).otherwise(F.col("answer"))
        return rows.select("id", answer.alias("answer"), "sources", F.lit(False).alias("used_model"), "is_relevant")
    other = rows.where(~F.col("is_relevant")).select("id", F.when(F.col("question") == "", v.ASK).otherwise(v.IRRELEVANT).alias("answer"), "sources", F.lit(False).alias("used_model"), "is_relevant")
    schema = rows.select("id").schema.add("answer", "string").add("sources", ArrayType(StringType())).add("used_model", "boolean").add("is_relevant", "boolean")

    def replied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = model(b.column(1).to_pylist(), b.column(3).to_pylist()) if b.num_rows else []
            yes = pa.array([True] * b.num_rows, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(replies, pa.string()), b.column(2), yes, yes], names=schema.names)

    return rows.where("is_relevant").select("id", "question", "sources", "contexts").mapInArrow(replied, schema).unionByName(other)
