"""The property graph: nodes, edges, statistics and neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text, valid
from ..sources.held import written
from .edges import first_wins

PROPERTIES = ["category", "caliber", "model", "core_model", "subtype", "page", "image_path", *v.PARAMETER_NAMES]
PROPERTIES = [p for k, p in enumerate(PROPERTIES) if p not in PROPERTIES[:k]]


@dataclass
class Graph:
    """nodes: seq (a struct that orders them), name, label, and properties where there are any. edges: seq, source, relation, relation_label, target,
    source_type, target_type, method, description."""

    nodes: DataFrame
    edges: DataFrame
    kept: bool = False

    def held(self) -> Graph:
        """The same graph, computed once and read from the shared folder from then on: for several questions to one graph."""
        return self if self.kept else Graph(written(self.nodes, "nodes"), written(self.edges, "edges"), True)


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One node for each name: the first label by seq, and of each property the last value that is not empty."""
    props = [c for c in rows.columns if c not in ("seq", "name", "label")]
    filled = [F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("seq"))).alias(c) for c in props]
    return rows.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by("label", "seq").alias("label"), *filled)


def build(entities: DataFrame, edges: DataFrame, view: str = "trusted", relations: list[str] | None = None, labels: list[str] | None = None, once: bool = False) -> Graph:
    """The graph of a view. entities: seq, name, label and properties, in order; edges: seq and the typed ends.

    Nodes that the view shows come first, then the ends of shown edges that are no nodes yet, labelled as the edge says or
    Unknown. Of edges with the same (source, relation, target) the first stays. Full views take all relations and labels.
    With ``once`` the graph is held, and its edges are worked out once, not again for the nodes at their ends. Without, nodes are made of
    all edges: the first edge of a name is the first of its kind, so those that go label no node."""
    shown = entities.where(valid.node(F.col("label"), F.col("name"), view, labels))
    every = edges.where(valid.edge(view, relations, labels))
    rows = first_wins(every)
    if once:
        every = rows = written(rows, "edges")
    own, theirs = (df.schema["seq"].dataType for df in (shown, rows))
    shown = shown.withColumn("seq", F.struct(F.lit(0).alias("kind"), F.col("seq").alias("entity"), F.lit(None).cast(theirs).alias("edge"), F.lit(0).alias("end")))
    ends = [F.struct(F.col("seq").alias("edge"), F.lit(k).alias("end"), F.col(e).alias("name"), F.coalesce(F.nullif(F.col(f"{e}_type"), F.lit("")), F.lit("Unknown")).alias("label")) for k, e in enumerate(("source", "target"))]
    firsts = every.select(F.inline(F.array(*ends))).groupBy("name", "label", "end").agg(F.min("edge").alias("edge"))  # numbers, so a hash aggregate; few rows are left
    firsts = firsts.select(F.struct(F.lit(1).alias("kind"), F.lit(None).cast(own).alias("entity"), "edge", "end").alias("seq"), "name", "label")
    nodes = merged_nodes(shown.unionByName(firsts, allowMissingColumns=True))
    names = F.create_map(*(F.lit(x) for pair in v.RELATIONS.items() for x in pair))
    have = set(rows.columns)
    method = F.coalesce("method", F.lit("base")) if "method" in have else F.lit("base")
    note = F.coalesce("description", F.lit("")) if "description" in have else F.lit("")
    kept = rows.select("seq", "source", "relation", F.coalesce(F.element_at(names, F.col("relation")), "relation").alias("relation_label"), "target", "source_type", "target_type", method.alias("method"), note.alias("description"))
    return Graph(written(nodes, "nodes"), kept, True) if once else Graph(nodes, kept)


# ---- statistics


def label_counts(g: Graph) -> DataFrame:
    """label, n; the most frequent first, ties by first appearance."""
    return g.nodes.groupBy("label").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").select("label", "n")


def relation_counts(g: Graph) -> DataFrame:
    return g.edges.groupBy("relation").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").select("relation", "n")


def top_targets(g: Graph, relation: str, label: str = "Artillery", k: int = 12) -> DataFrame:
    """The ``k`` most frequent targets of a relation from nodes of a label; ties by the name of the first source."""
    own = g.nodes.where(F.col("label") == label).select(F.col("name").alias("source"))
    rows = g.edges.where(F.col("relation") == relation).join(own, "source", "left_semi")
    ranked = rows.groupBy("target").agg(F.count("*").alias("n"), F.min(F.struct("source", "seq")).alias("first"))
    return ranked.orderBy(F.desc("n"), "first").limit(k).select("target", "n")


def top_categories(g: Graph, k: int = 12) -> DataFrame:
    rows = g.nodes.where("category <> ''").groupBy("category").agg(F.count("*").alias("n"), F.min("name").alias("first"))
    return rows.orderBy(F.desc("n"), "first").limit(k).select("category", "n")


def totals(g: Graph) -> DataFrame:
    nodes = g.nodes.agg(F.count("*").alias("n_nodes"))
    return nodes.join(F.broadcast(g.edges.agg(F.count("*").alias("n_edges"))))


def bars(pairs: DataFrame, name: str, value: str = "n") -> DataFrame:
    """name, value of at most a chart's worth of pairs, the largest last, as horizontal bars are drawn from below; of equals
    the one that the pairs have last comes first."""
    rows = [(r[name], r[value]) for r in pairs.select(name, value).collect()]  # a top-k
    schema = pairs.select(name, value).schema.add("ord", "integer", False)
    return pairs.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(reversed(rows))], schema)


def names_by_label(g: Graph) -> DataFrame:
    """label, name, sorted: a row for each name, however many a label has."""
    return g.nodes.select("label", "name").distinct().orderBy("label", "name")


# ---- neighbourhoods


def degrees(g: Graph) -> DataFrame:
    """name, n_out, n_in of each node, from counts that are summed before they are joined."""
    out = g.edges.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("o"))
    into = g.edges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("i"))
    both = g.nodes.select("name").join(out, "name", "left").join(into, "name", "left")
    return both.select("name", F.coalesce("o", F.lit(0)).alias("n_out"), F.coalesce("i", F.lit(0)).alias("n_in"))


def relation_groups(g: Graph, name: str) -> DataFrame:
    """relation_label, members: a node's distinct targets by relation; what derives from it counts among its derivatives."""
    out = g.edges.where(F.col("source") == name).select("relation_label", F.col("target").alias("m"))
    back = g.edges.where((F.col("target") == name) & (F.col("relation") == "DERIVED_FROM")).select(F.lit(v.RELATIONS["DERIVED_FROM"]).alias("relation_label"), F.col("source").alias("m"))
    return out.unionByName(back).groupBy("relation_label").agg(F.sort_array(F.collect_set("m")).alias("members"))


def _rank(priority: list[str]) -> Column:
    at = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("relation")).cast("int"), F.lit(0))
    return F.when(at > 0, at).otherwise(99)


def one_hop(g: Graph, center: str, most: int = 14, priority: list[str] = v.PRIORITY) -> Graph:
    """A node with its neighbours, ``most`` nodes at most: neighbours are taken in as their edges come, by priority of the
    relation, then target, then source; all edges to those taken in stay. A self loop shows twice, once for each end."""
    ends = [F.when(F.col(e) == center, F.struct(F.col(o).alias("other"), F.lit(k).alias("side"))) for k, (e, o) in enumerate((("source", "target"), ("target", "source")))]
    rows = g.edges.where((F.col("source") == center) | (F.col("target") == center)).withColumn("_end", F.explode(F.array(*ends))).where("_end is not null")
    rows = rows.select(*g.edges.columns, "_end.other", "_end.side", _rank(priority).alias("rank"))
    place = F.struct("rank", "target", "source", "side", "seq")
    firsts = rows.where(F.col("other") != center).groupBy("other").agg(F.min(place).alias("first")).orderBy("first").limit(most - 1)
    taken = firsts.select("other").unionByName(g.nodes.sparkSession.range(1).select(F.lit(center).alias("other")))
    edges = rows.join(taken, "other", "left_semi").select(*g.edges.columns)
    return Graph(g.nodes.join(taken.withColumnRenamed("other", "name"), "name", "left_semi"), edges)


def neighbourhoods(g: Graph, centers: DataFrame, most: int = 14, priority: list[str] = v.PRIORITY, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(center and the nodes, center and the edges) of ``one_hop`` around each of many centers. centers: name.

    A neighbour's first edge is a combining minimum. The best neighbours are chosen twice: of each center's share in each
    of ``salts`` parts, then of these few, so a hub is not one task's; only edges to those taken are looked up again."""
    asked = centers.select(F.col("name").alias("center")).where("center is not null").distinct()
    ends = F.explode(F.array(*(F.struct(F.col(e).alias("center"), F.col(o).alias("other"), F.lit(k).alias("side")) for k, (e, o) in enumerate((("source", "target"), ("target", "source"))))))
    rows = g.edges.withColumn("_end", ends).select(*g.edges.columns, "_end.*", _rank(priority).alias("rank")).join(asked, "center", "left_semi")
    firsts = rows.where(F.col("other") != F.col("center")).groupBy("center", "other").agg(F.min(F.struct("rank", "target", "source", "side", "seq")).alias("first"))
    firsts = firsts.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(salts)))
    for keys in (["center", "salt"], ["center"]):
        firsts = firsts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first"))).where(F.col("place") < most)
    taken = firsts.select("center", "other").unionByName(asked.select("center", F.col("center").alias("other")))
    edges = rows.join(taken, ["center", "other"], "left_semi").select("center", *g.edges.columns)
    return g.nodes.join(taken.withColumnRenamed("other", "name"), "name").select("center", *g.nodes.columns), edges


def related(g: Graph, name: str, label: str = "Artillery") -> DataFrame:
    """Names of a label next to a node, in either direction, sorted."""
    to = g.edges.where((F.col("source") == name) & (F.col("target_type") == label)).select(F.col("target").alias("name"))
    back = g.edges.where((F.col("target") == name) & (F.col("source_type") == label)).select(F.col("source").alias("name"))
    return to.unionByName(back).distinct().orderBy("name")


def reach(g: Graph, start: DataFrame, hops: int) -> DataFrame:
    """name, hop: what can be reached from the names in ``start`` along edges in at most ``hops`` steps."""
    pairs = g.edges.select("source", "target")
    if hops > 1 and not g.kept:
        pairs = written(pairs, "reach")  # made once, not once a hop
    seen = start.select("name").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        now = seen.where(F.col("hop") == hop - 1).select(F.col("name").alias("source"))
        new = pairs.join(now, "source", "left_semi").select(F.col("target").alias("name")).distinct()
        seen = seen.unionByName(new.join(seen, "name", "left_anti").withColumn("hop", F.lit(hop)))
    return seen


# ---- lookup


def find(g: Graph, query: str, label: str | None = None) -> DataFrame:
    """At most one row, name: the node of exactly that name; else the first one equal, else containing it, when white space
    and case do not count. Nodes of a label are tried by name, all nodes in order. A query of white space hits the first, an empty one none."""
    if not query:
        return g.nodes.select("name").limit(0)
    rows = g.nodes.where(F.col("label") == label) if label else g.nodes
    needle, own = text.normalised_name(F.lit(query)), text.normalised_name(F.col("name"))
    tier = F.when(F.col("name") == query, 0).when(own == needle, 1).when(F.contains(own, needle), 2)
    order = F.col("name") if label else F.col("seq")
    return rows.withColumn("tier", tier).where("tier is not null").orderBy("tier", order).limit(1).select("name")


def mentioned(g: Graph, question: str, label: str) -> DataFrame:
    """At most one row, name: the first name of a label, in order, that the question contains."""
    q, own = text.normalised_name(F.lit(question)), text.normalised_name(F.col("name"))
    return g.nodes.where((F.col("label") == label) & (own != "") & F.contains(q, own)).orderBy("name").limit(1).select("name")


def in_category(nodes: DataFrame, category: str | None = None) -> DataFrame:
    """nodes of a category, of all without one; a missing category reads as unknown."""
    rows = nodes.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(v.UNKNOWN)))
    return rows if category is None else rows.where(F.col("category") == category)


def suggestions(g: Graph, wanted: list[str], label: str = "Artillery", k: int = 8) -> DataFrame:
    """name, ord: those of ``wanted`` that are nodes, then the first ``k`` names of a label, each once."""
    names = g.nodes.sparkSession.createDataFrame(list(enumerate(wanted)), "ord long, name string").join(g.nodes.select("name"), "name", "left_semi")
    more = g.nodes.where(F.col("label") == label).orderBy("name").limit(k).select("name").withColumn("ord", F.lit(len(wanted)) + F.row_number().over(Window.orderBy("name")))
    return names.unionByName(more).groupBy("name").agg(F.min("ord").alias("ord")).orderBy("ord")
