"""Lexical retrieval over the graph and its texts, and answers from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text
from ..vocabulary import EDGE, IRRELEVANT, LEAST, LONG, MENTION, MODEL, NAME, NEIGHBOUR, ONLY_FOUND, SHORT, TOP, UNSUPPORTED
from . import graph
from .graph import Graph


def scores(g: Graph, texts: DataFrame, question: str, label: str = "Artillery") -> DataFrame:
    """name, score of the nodes of a label: its name and model in the question, the question's tokens in what is known of it,
    and its targets in the question. One pass over nodes and one over edges, whatever the question is."""
    q = text.normalised_name(F.lit(question))
    own = g.nodes.where(F.col("label") == label).join(texts.select("name", F.substring("text", 1, 1800).alias("text")), "name", "left")  # cut before it is shuffled
    none = lambda c: F.coalesce(F.col(c), F.lit("")) if c in own.columns else F.lit("")
    searchable = text.normalised_name(F.concat_ws(" ", F.col("name"), none("model"), none("core_model"), none("category"), none("text")))
    words = F.transform(text.tokens(F.lit(question)), lambda t: F.struct(text.normalised_name(t).alias("t"), F.when(F.length(t) > 2, LONG).otherwise(SHORT).alias("w")))
    by_words = F.aggregate(words, F.lit(0), lambda a, w: a + F.when((w["t"] != "") & F.contains(F.col("searchable"), w["t"]), w["w"]).otherwise(0))
    named = F.when(F.contains(q, text.normalised_name(F.col("name"))), NAME).otherwise(0)
    model = F.when((none("model") != "") & F.contains(q, text.normalised_name(none("model"))), MODEL).otherwise(0)
    hits = g.edges.where(F.contains(q, text.normalised_name(F.col("target")))).groupBy(F.col("source").alias("name")).agg((F.count("*") * EDGE).alias("edges"))
    rows = own.withColumn("searchable", searchable).join(hits, "name", "left")
    return rows.select("name", (named + model + by_words + F.coalesce("edges", F.lit(0))).cast("long").alias("score"))


def mentions(g: Graph, question: str) -> DataFrame:
    """label, name of all nodes that the question contains."""
    q = text.normalised_name(F.lit(question))
    return g.nodes.where(F.contains(q, text.normalised_name(F.col("name")))).select("label", "name")


def candidates(g: Graph, texts: DataFrame, question: str, k: int = TOP, label: str = "Artillery") -> DataFrame:
    """name, score of the best ``k``, ties by name; without any, neighbours of mentioned nodes at a fixed score. They are looked
    for at once, and what is returned is the ``k`` rows themselves, so they can be used again and again."""
    best = scores(g, texts, question, label).where("score > 0").orderBy(F.desc("score"), "name").limit(k).collect()
    if best:
        return g.nodes.sparkSession.createDataFrame(best, "name string, score long")
    found = mentions(g, question).select(F.col("name").alias("m")).distinct()
    to = g.edges.where(F.col("source_type") == label).join(found, F.col("target") == F.col("m"), "left_semi").select(F.col("source").alias("name"))
    back = g.edges.where(F.col("target_type") == label).join(found, F.col("source") == F.col("m"), "left_semi").select(F.col("target").alias("name"))
    near = to.unionByName(back).distinct().orderBy("name").limit(k).collect()
    return g.nodes.sparkSession.createDataFrame([(r.name, NEIGHBOUR) for r in near], "name string, score long")


def blocks(g: Graph, texts: DataFrame, chosen: DataFrame, facts: list[tuple[str, str]] = v.FACTS, n_relations: int = 12, n_chars: int = 1200, few: bool = True) -> DataFrame:
    """name, score, context: what is shown of each candidate. chosen: name, score. ``few`` of them are sent to nodes, texts and edges,
    of which only theirs move."""
    names = chosen.select("name")
    if few:
        names = F.broadcast(names)
    cut = texts.select("name", F.substring("text", 1, n_chars).alias("text")).join(names, "name", "left_semi")
    rows = chosen.join(g.nodes.join(names, "name", "left_semi"), "name", "left").join(cut, "name", "left")
    own = g.edges.join(names.withColumnRenamed("name", "source"), "source", "left_semi")
    rels = own.groupBy(F.col("source").alias("name")).agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", F.concat("relation_label", F.lit("->"), "target").alias("r")))), 1, n_relations).alias("rels"))
    rows = rows.join(rels, "name", "left")
    facts = [f for f in facts if f[0] in g.nodes.columns]
    shown = F.filter(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.col(c).cast("string"))) for c, n in facts)), lambda x: x.isNotNull())
    links = F.coalesce(F.transform("rels", lambda x: x["r"]), F.array().cast("array<string>"))
    excerpt = F.when(F.coalesce("text", F.lit("")) != "", F.col("text")).otherwise(F.lit(v.NOTHING))
    lines = [F.concat(F.lit(v.BLOCK), F.col("name")), F.concat(F.lit(v.BLOCK_FACTS), text.joined_or(shown, v.NOTHING)), F.concat(F.lit(v.BLOCK_RELATIONS), text.joined_or(links, v.NOTHING)), F.concat(F.lit(v.BLOCK_TEXT), excerpt)]
    return rows.select("name", "score", F.concat_ws("\n", *lines).alias("context"))


def relevance(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """One row: score, is_relevant."""
    total = chosen.agg(F.coalesce(F.sum("score"), F.lit(0)).alias("s")).join(F.broadcast(found.agg(F.count("*").alias("m"))))
    score = (F.col("s") + MENTION * F.col("m")).cast("long")
    return total.select(score.alias("score"), (score >= LEAST).alias("is_relevant"))


# ---- answers. A question picks a branch on the driver from at most one name for each label; each branch is one query.


def sources_with(g: Graph, *wanted: tuple[str, str], label: str = "Artillery") -> DataFrame:
    """name of the nodes of a label that have all the (relation, target) edges: one grouping over the edges in question."""
    hits = [F.bool_or((F.col("relation") == r) & (F.col("target") == t)) for r, t in wanted]
    some = F.lit(False)
    for r, t in wanted:
        some = some | ((F.col("relation") == r) & (F.col("target") == t))
    rows = g.edges.where(some).groupBy(F.col("source").alias("name")).agg(*(h.alias(f"h{k}") for k, h in enumerate(hits)))
    for k in range(len(hits)):
        rows = rows.where(f"h{k}")
    return g.nodes.where(F.col("label") == label).select("name").join(rows.select("name"), "name", "left_semi").orderBy("name")


def largest(g: Graph, relation: str, target: str, metric: str = "caliber", unit: str = v.UNIT, label: str = "Artillery") -> DataFrame:
    """name, value of the node with the largest metric among those with an edge; of equals the first by name."""
    value = text.number(F.replace(F.col(metric).cast("string"), F.lit(unit)))
    own = sources_with(g, (relation, target), label=label)
    return g.nodes.join(own, "name", "left_semi").select("name", value.alias("value")).where("value is not null").orderBy(F.desc("value"), "name").limit(1)


def _names(df: DataFrame, k: int) -> list[str]:
    return [r.name for r in df.limit(k).collect()]


def answer(g: Graph, question: str) -> str:
    """An answer from the graph alone, by the first intent that fits."""
    q = question.strip()
    if not q:
        return v.ASK
    war, maker, ride, country = ((_names(graph.mentioned(g, q, x), 1) or [None])[0] for x in ("War", "Institution", "Chassis", "Country"))
    if war and maker and "哪" in q:
        found = _names(sources_with(g, ("PARTICIPATED_IN", war), ("DESIGNED_BY", maker)), 12)
        return (v.BOTH if found else v.NOT_BOTH).format(war=war, maker=maker, names="；".join(found))
    if ride and ("口径最大" in q or "最大口径" in q):
        best = largest(g, "USES_CHASSIS", ride).collect()
        if not best:
            return v.NO_LARGEST.format(ride=ride)
        return v.LARGEST.format(ride=ride, name=best[0].name, value=best[0].value)
    if war and "哪些" in q:
        found = _names(sources_with(g, ("PARTICIPATED_IN", war)), 15)
        return (v.OF_WAR if found else v.NOT_OF_WAR).format(war=war, names="；".join(found))
    if country and ("研制" in q or "研发" in q or "developed" in q.lower()):
        found = _names(sources_with(g, ("DEVELOPED_IN", country)), 15)
        return (v.OF_COUNTRY if found else v.NOT_OF_COUNTRY).format(country=country, names="；".join(found))
    for name in _names(graph.find(g, q), 1):
        out = g.edges.where(F.col("source") == name).orderBy("seq").select(F.concat("relation_label", F.lit(" -> "), "target").alias("name"))
        back = g.edges.where(F.col("target") == name).orderBy("seq").select(F.concat("source", F.lit(" -> "), "relation_label").alias("name"))
        parts = [f"{what}: {'；'.join(found)}" for what, df in ((v.OUT, out), (v.IN, back)) if (found := _names(df, 6))]
        if parts:
            return v.LOCAL.format(name=name, edges=" ".join(parts))
    return UNSUPPORTED


def answer_with_context(g: Graph, texts: DataFrame, question: str, model: Callable[[str, list[str]], str] | None = None) -> dict:
    """answer, sources, used_model, is_relevant. model: (question, contexts) to answer, injected; without it the graph answers,
    and where it cannot, the first two contexts are shown."""
    q = question.strip()
    if not q:
        return {"answer": v.ASK, "sources": [], "used_model": False, "is_relevant": False}
    chosen = candidates(g, texts, q)
    if not relevance(chosen, mentions(g, q)).first().is_relevant:
        return {"answer": IRRELEVANT, "sources": [], "used_model": False, "is_relevant": False}
    rows = blocks(g, texts, chosen).orderBy(F.desc("score"), "name").collect()  # four at most
    contexts, sources = [r.context for r in rows], [r.name for r in rows]
    if model is not None:
        return {"answer": model(q, contexts), "sources": sources, "used_model": True, "is_relevant": True}
    said = answer(g, q)
    return {"answer": ONLY_FOUND + "\n\n".join(contexts[:2]) if said == UNSUPPORTED else said, "sources": sources, "used_model": False, "is_relevant": True}
