"""Rule-based extraction to typed edges, and edges from elsewhere merged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import match, text
from ..sources.held import dealt
from ..sources.replies import Replies
from . import derive

EDGE = ["source", "source_type", "relation", "target", "target_type"]


def first_wins(rows: DataFrame, by: list[str] | None = None, order: str = "seq") -> DataFrame:
    """Of rows that share a key the one that comes first. They are dealt and sorted by a hash of the key before the key itself, so
    texts are compared only where hashes are equal."""
    keys = by or ["source", "relation", "target"]
    own = Window.partitionBy("_h", *keys).orderBy(order)
    return dealt(rows.withColumn("_h", F.xxhash64(*keys)), "_h").withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n", "_h")


def rule_record(docs: DataFrame, name: str = "name", body: str = "text") -> DataFrame:
    """docs with an array of names for each dictionary: wars, institutions, chassis, ammunition, designers, nations (in the
    500 characters of the service section), subtypes and branches; all from one projection over the text."""
    t, n = F.col(body), F.col(name)
    found = {
        "wars": match.matches(v.WARS, t), "institutions": match.matches(v.INSTITUTIONS, t), "chassis": match.matches(v.CHASSIS, t), "ammunition": match.matches(v.AMMUNITION, t),
        "designers": match.matches(v.DESIGNERS, t), "nations": match.matches(v.NATIONS, text.slice_after(t, v.SERVICE_SECTION, 500)),
        "subtypes": match.matches(v.SUBTYPES, t, n), "branches": match.matches(v.BRANCHES, t),
    }
    return docs.withColumns(found)


# relation and type of what each array holds, in the order in which edges are numbered
KINDS = [
    ("wars", "PARTICIPATED_IN", "War"), ("institutions", "DESIGNED_BY", "Institution"), ("designers", "DESIGNED_BY", "Designer"), ("chassis", "USES_CHASSIS", "Chassis"),
    ("ammunition", "USES_AMMO", "Ammunition"), ("nations", "EQUIPPED_BY", "Country"), ("subtypes", "IS_SUBTYPE_OF", "SubCategory"), ("branches", "SERVED_IN", "MilitaryBranch"),
]


def _to(relation: str, kind: str):
    return lambda x: F.struct(F.lit(relation).alias("relation"), x.alias("target"), F.lit(kind).alias("target_type"))


def property_names(params: Column) -> Column:
    """``name=value`` of each parameter with a value."""
    labels = F.create_map(*(F.lit(x) for pair in v.PARAMETER_NAMES.items() for x in pair))
    pairs = F.filter(F.map_entries(params), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.transform(pairs, lambda e: F.concat(F.coalesce(F.element_at(labels, e["key"]), e["key"]), F.lit("="), e["value"]))


def _place(*parts) -> Column:
    return F.array(*((F.lit(p) if isinstance(p, int) else F.col(p)).cast("long") for p in parts)).alias("seq")


def rule_edges(docs: DataFrame, name: str = "name", body: str = "text", params: str | None = "parameters", label: str = "Artillery") -> DataFrame:
    """seq, source, source_type, relation, target, target_type, method, description of the texts that are not empty.

    Derivatives point at their origin; all other edges start from the entity. ``docs`` needs seq (long); an edge's seq is an
    array of it, 0 or, for derivatives, 1, and the place among them, so any number of edges is in order."""
    rows = rule_record(docs.where(F.col(body) != ""), name, body)
    made = [F.transform(c, _to(r, k)) for c, r, k in KINDS]
    if params:
        made.append(F.transform(property_names(F.coalesce(F.col(params), F.create_map().cast("map<string,string>"))), _to("HAS_PROPERTY", "Property")))
    rows = rows.select("seq", F.col(name).alias("source"), F.posexplode(F.concat(*made)).alias("k", "e"))
    out = rows.select(_place("seq", 0, "k"), "source", F.lit(label).alias("source_type"), "e.*", F.lit("rule").alias("method"), F.lit("").alias("description"))
    found = derive.derivatives(docs.where(F.col(body) != "").withColumn("_key", F.struct("seq", F.col(name).alias("name"))).select(F.to_json("_key").alias("key"), body), "key", body)
    own = F.from_json("key", "seq long, name string")
    back = found.select(own.alias("o"), "ord", "derivative", "description").select(
        _place("o.seq", 1, "ord"), F.col("derivative").alias("source"), F.lit("Derivative").alias("source_type"), F.lit("DERIVED_FROM").alias("relation"),
        F.col("o.name").alias("target"), F.lit(label).alias("target_type"), F.lit("rule").alias("method"), "description",
    )
    return out.unionByName(back)


def entities_of(edges: DataFrame) -> DataFrame:
    """label, name: both ends of edges, each once."""
    ends = F.explode(F.array(F.struct(F.col("source_type").alias("label"), F.col("source").alias("name")), F.struct(F.col("target_type").alias("label"), F.col("target").alias("name"))))
    return edges.select(ends.alias("e")).select("e.*").distinct()


def merged(known: DataFrame, more: DataFrame, method: str = "llm") -> DataFrame:
    """known, and of ``more`` (with seq) the first row of each (source, relation, target) that known has not."""
    fresh = first_wins(more.join(known.select("source", "relation", "target").distinct(), ["source", "relation", "target"], "left_anti"))
    return known.unionByName(fresh.withColumn("method", F.lit(method)), allowMissingColumns=True)


def prompts(docs: DataFrame, body: str = "text", prompt_chars: int = 3000) -> DataFrame:
    """seq, prompt of the rows with a text."""
    return docs.select(F.col("seq").cast("long").alias("seq"), F.substring(F.col(body), 1, prompt_chars).alias("prompt")).where("prompt is not null")


def model_edges(docs: DataFrame, replies: Callable[[list[str]], list[str | None]], body: str = "text", prompt_chars: int = 3000, kept: Replies | None = None) -> DataFrame:
    """seq (an array: the row's and the place in its reply) and edges that an injected model's replies hold.

    replies: a batch of prompt texts to as many reply texts, None on failure; it runs on the executors, once an Arrow batch.
    Rows with null texts are not asked about. Malformed replies and null ends give none. With ``kept`` only prompts without a
    kept reply are asked, each once, and replies are written before they are used."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = replies(batch.column(1).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], names=["seq", "reply"])

    asked = prompts(docs, body, prompt_chars)
    said = asked.mapInArrow(ask, "seq long, reply string") if kept is None else kept.answered(asked, replies)
    rows = said.select("seq", text.relations_in_reply(F.col("reply")).alias("r"))
    found = rows.select("seq", F.posexplode("r").alias("k", "e")).select(_place("seq", "k"), "e.*")
    return found.where("source <> '' and relation <> '' and target <> ''")


def counts(edges: DataFrame, by: str, default: str = "rule") -> DataFrame:
    """How many edges of each relation or method, by name."""
    return edges.groupBy(F.coalesce(by, F.lit(default)).alias(by)).agg(F.count("*").alias("n")).orderBy(by)
