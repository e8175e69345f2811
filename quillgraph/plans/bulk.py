"""Queries that put a whole table of questions to an index."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..operators import answers, assign, clean, dictionaries, edges, graph, lookup, outline, scan
from ..sources import versions
from ..sources.held import shared_dir, written
from ..sources.replies import Replies
from . import rich, star
from .star import GRAPH_SQL, table


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """id, question: whole texts of benchmark with a part, a nation and a brand."""
    b, n = table(spark, sf, "benchmark"), table(spark, sf, "nation")
    number = F.col("item_id").cast("string")
    rows = b.join(n, F.col("item_id") % 25 == F.col("n_nationkey"))
    return rows.select(F.col("item_id").alias("id"), F.concat("text", F.lit(" part#"), number, F.lit(" "), "n_name", F.lit(" BRAND#"), number, F.lit(" promo")).alias("question"))


def _index(spark: SparkSession, sf: str, chars: int | None = lookup.TEXT_CHARS) -> lookup.Index:
    return lookup.index(star.build(spark, sf, once=True), star.texts(spark, sf), chars=chars)


def dict_match_items(spark: SparkSession, sf: str) -> DataFrame:
    """Words of benchmark, six characters and more, that stand anywhere in a document."""
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).where("length(word) >= 6")
    return dictionaries.matched(table(spark, sf, "documents"), words.select(F.col("word").alias("name"), "word"))


def questions_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.candidates(_index(spark, sf, None), _questions(spark, sf))


def questions_mentions(spark: SparkSession, sf: str) -> DataFrame:
    ix = lookup.index(star.build(spark, sf), star.texts(spark, sf))  # its names are all that is asked of it
    return lookup.mentions(ix, _questions(spark, sf))


def questions_relevance(spark: SparkSession, sf: str) -> DataFrame:
    ix, rows = _index(spark, sf, None), _questions(spark, sf)
    return lookup.relevance(ix, rows, lookup.candidates(ix, rows))


def _lookups(spark: SparkSession, sf: str) -> DataFrame:
    """id, question for each part: a name, one in other letters and spaces, an inner part of one, and one or two characters."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    question = (
        F.when(k % 5 == 0, F.concat(F.lit("part#"), text)).when(k % 5 == 1, F.concat(F.lit(" PART # "), text)).when(k % 5 == 2, F.concat(F.lit("T#"), text))
        .when(k % 5 == 3, F.substring(text, -2, 2)).otherwise(F.concat(F.lit("N_"), (k % 30).cast("string")))
    )
    return table(spark, sf, "part").select(k.alias("id"), question.alias("question"))


def questions_find(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.find_all(_index(spark, sf), _lookups(spark, sf))


def answers_local(spark: SparkSession, sf: str) -> DataFrame:
    return answers.answers(_index(spark, sf), _lookups(spark, sf))


def _pick(entries: list, n: Column) -> Column:
    return F.get(F.array(*(F.lit(name) for name, _ in entries)), F.pmod(n, F.lit(len(entries))).cast("int"))


def _intents(spark: SparkSession, sf: str) -> DataFrame:
    """id, question for each part: of a war and a maker, a chassis, a war, a country, and of nothing known."""
    k = F.col("p_partkey")
    n = F.floor(k / 5)
    question = (
        F.when(k % 5 == 0, F.concat(_pick(v.WARS, n), F.lit("中哪些火炮由"), _pick(v.INSTITUTIONS, n), F.lit("设计？"))).when(k % 5 == 1, F.concat(F.lit(" 基于"), _pick(v.CHASSIS, n), F.lit("的火炮，口径最大的是什么")))
        .when(k % 5 == 2, F.concat(_pick(v.WARS, n), F.lit("有哪些火炮"))).when(k % 5 == 3, F.concat(F.lit("Developed in "), _pick(v.NATIONS, n))).otherwise(F.concat(F.lit("你好"), k.cast("string")))
    )
    return table(spark, sf, "part").select(k.alias("id"), question.alias("question"))


def answers_bulk(spark: SparkSession, sf: str) -> DataFrame:
    g = rich._graph(spark, sf)
    return answers.answers(lookup.index(g, rich.docs(spark, sf).select("name", "text")), _intents(spark, sf))


def answers_context_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """The refusal, answers of the graph, and two contexts where it has none, for the questions of both kinds."""
    ix, rows = _index(spark, sf), _questions(spark, sf)
    odd = rows.select((-1 - F.col("id")).alias("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("zz"), F.col("id").cast("string"), F.lit("zz"))).otherwise(" ").alias("question"))
    found = answers.answers_with_context(ix, star.texts(spark, sf), rows.unionByName(odd))
    return found.select("id", F.substring_index("answer", "\n", 2).alias("head"), F.array_join("sources", ",").alias("sources"), "used_model", "is_relevant")


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Three imports into a kept store: nodes and edges by kind and name in each version, and each import's counts."""
    kept = versions.Store(spark, f"{shared_dir(spark)}/quillgraph/store-{uuid.uuid4().hex}", 16)
    n, e = star.entities(spark, sf), written(star.edges(spark, sf), "edges")
    for k in range(3):  # parts by key; an edge comes with the batch of its part, or one later
        kept.upsert(n.where(F.pmod("seq", F.lit(3)) == k), e.where(F.expr(f"(seq % 3 + seq div {star.OWN} % 3) % 3 = {k}")))
    rows = None
    for number in kept.versions():
        nodes, links = kept.read(number)
        of = lambda df, c, kind: df.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(number).cast("long").alias("version"), F.lit(kind).alias("kind"), F.col(c).alias("name"), "n")  # noqa: E731, B023
        now = of(nodes, "label", "node").unionByName(of(links, "relation", "edge"))
        rows = now if rows is None else rows.unionByName(now)
    counts = kept.history().select("version", F.lit("import").alias("kind"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in ("success", "failed", "unmatched")))))
    return rows.unionByName(counts)


def store_upserted(spark: SparkSession, sf: str) -> DataFrame:
    """Properties of nodes after three imports of the same parts, each of fewer of them and with other sizes."""
    kept = versions.Store(spark, f"{shared_dir(spark)}/quillgraph/store-{uuid.uuid4().hex}", 16)
    n = star.entities(spark, sf).where("label = 'Artillery'")
    for k in (1, 2, 3):
        kept.upsert(n.where(F.col("seq") % k == 0).withColumn("caliber", F.concat(F.lit(f"v{k} "), "caliber")), star.edges(spark, sf).limit(0))
    return kept.read()[0].select("label", "name", "caliber", "model", "page")


def neighbourhoods(spark: SparkSession, sf: str) -> DataFrame:
    """Edges around all nations at once, and around one part in each hundred."""
    n, p = table(spark, sf, "nation").select(F.col("n_name").alias("name")), table(spark, sf, "part").where("p_partkey % 100 = 0").select(star.part().alias("name"))
    return graph.neighbourhoods(star.build(spark, sf, once=True), n.unionByName(p))[1].select("center", "source", "relation", "target")


def scan_events(spark: SparkSession, sf: str) -> DataFrame:
    """Of all events in one order: the last error's value so far, how many clicks, the highest value, with no key to part them by."""
    kind = F.col("event_type")
    steps = {"last_error": ("last", F.when(kind == "error", F.col("value"))), "clicks": ("sum", F.when(kind == "click", F.lit(1)).cast("long")), "highest": ("max", F.col("value"))}
    return scan.scanned(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_id"], steps).select("event_id", *steps)


def ffill_unkeyed(spark: SparkSession, sf: str) -> DataFrame:
    """The role of the last turn that no user wrote, over all conversations as one outline."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role").distinct()
    one = c.groupBy("seq").agg(F.min("role").alias("role"))
    return outline.filled_forward(one, F.col("role"), F.col("role") != "user", "seq", "head")


def range_long(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to the supplier whose range they fall into: ranges of 70 keys, the last one of a billion."""
    starts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 70).alias("page"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"))
    rows = assign.pages_of(assign.ranges(starts, 10**9), pages)
    return rows.groupBy("name").agg(F.min("page_no").alias("first_key"), F.max("page_no").alias("last_key"), F.count("*").alias("n"))


def edges_from_model(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of a model whose replies are kept, after cleaning: those of every ninth part but the ones that it always fails on."""
    def ask(prompts: list[str]) -> list[str | None]:
        reply = '{{"relations": [{{"source": "{0}", "source_type": "Artillery", "relation": "USES_CHASSIS", "target": "模型底盘", "target_type": "Chassis"}}]}}'
        return [None if "3" in p else reply.format(p) for p in prompts]

    kept = Replies(spark, f"{shared_dir(spark)}/quillgraph/replies-{uuid.uuid4().hex}", "m", tries=2, rounds=3)
    own = rich.entities(spark, sf)
    asked = edges.model_edges(own.where(F.col("k") % 9 == 0), ask, "name", kept=kept).withColumns({"method": F.lit("llm"), "description": F.lit("")})
    clean_rows = clean.clean_edges(rich._base(spark, sf), asked, own.select("name"), own.select("seq", "name", "home"))
    return clean_rows.where("method = 'llm'").select("source", "relation", "target", "method")


_NORM = r"lower(regexp_replace({}, '[\s\x{{3000}}\x{{00A0}}]+', '', 'g'))"


def _norm(x: str) -> str:
    return _NORM.format(x)


_QUESTIONS = f"""q AS (SELECT *, {_norm('question')} AS qn FROM (SELECT item_id AS id, text || ' part#' || item_id || ' ' || n_name || ' BRAND#' || item_id || ' promo' AS question FROM benchmark JOIN nation ON item_id % 25 = n_nationkey))"""
_TOPK = f"""hit AS (SELECT id, source AS name, count(*) * 5 AS edges FROM q JOIN e ON contains(qn, {_norm('target')}) GROUP BY ALL),
    txt AS (SELECT 'part#' || doc_id AS name, text FROM documents),
    own AS (SELECT n.name, {_norm('n.name')} AS nn, {_norm("coalesce(model, '')")} AS mn,
            {_norm("concat_ws(' ', n.name, coalesce(model, ''), coalesce(core_model, ''), coalesce(category, ''), coalesce(text, ''))")} AS s FROM n LEFT JOIN txt USING (name) WHERE label = 'Artillery'),
    tok AS (SELECT id, lower(t) AS t, sum(CASE WHEN length(t) > 2 THEN 2 ELSE 1 END) AS w FROM (SELECT id, unnest(regexp_extract_all(question, '[A-Za-z0-9][A-Za-z0-9\\-]*|[一-龥]{{2,}}')) AS t FROM q) GROUP BY id, lower(t)),
    inside AS (SELECT d.t, name FROM (SELECT DISTINCT t FROM tok) d JOIN own ON contains(s, d.t)),
    part AS (SELECT id, name, w AS p FROM tok JOIN inside USING (t) UNION ALL SELECT id, name, edges FROM hit WHERE name IN (SELECT name FROM own)
             UNION ALL SELECT id, name, CASE WHEN contains(qn, nn) THEN 12 ELSE 0 END + CASE WHEN mn <> '' AND contains(qn, mn) THEN 8 ELSE 0 END FROM q, own),
    sc AS (SELECT id, name, CAST(sum(p) AS BIGINT) AS score FROM part GROUP BY id, name HAVING sum(p) > 0),
    top AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, name) <= 4)"""
_TOPK_CUT = _TOPK.replace("coalesce(text, '')", "substr(coalesce(text, ''), 1, 1800)")
_MENTIONS = f"men AS (SELECT id, label, name FROM q JOIN n ON contains(qn, {_norm('name')}))"
_LOOKUPS = f"""q AS (SELECT *, {_norm('question')} AS qn FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'part#' || p_partkey WHEN 1 THEN ' PART # ' || p_partkey WHEN 2 THEN 'T#' || p_partkey
           WHEN 3 THEN right(CAST(p_partkey AS VARCHAR), 2) ELSE 'N_' || p_partkey % 30 END AS question FROM part)),
    qs AS (SELECT id, {{q}} AS question, qn FROM q), nn AS (SELECT name, place, {_norm('name')} AS own FROM n),
    f AS (SELECT id, name FROM qs JOIN nn ON contains(own, qn) QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN name = question THEN 0 WHEN own = qn THEN 1 ELSE 2 END, place) = 1)"""


def _graph(select: str, *more: str) -> str:
    return f"WITH {GRAPH_SQL}, {', '.join(more)} {select}"


def _name_at(entries: list) -> str:
    return "[" + ", ".join(f"'{name}'" for name, _ in entries) + f"][CAST((p_partkey // 5) % {len(entries)} AS INT) + 1]"


_INTENTS = f"""q AS (SELECT *, {_norm('question')} AS qn FROM (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN {_name_at(v.WARS)} || '中哪些火炮由' || {_name_at(v.INSTITUTIONS)} || '设计？' WHEN 1 THEN '基于' || {_name_at(v.CHASSIS)} || '的火炮，口径最大的是什么'
           WHEN 2 THEN {_name_at(v.WARS)} || '有哪些火炮' WHEN 3 THEN 'Developed in ' || {_name_at(v.NATIONS)} ELSE '你好' || p_partkey END AS question FROM part)),
    src AS (SELECT DISTINCT relation, target_type, target, source FROM kept WHERE relation <> 'DERIVED_FROM' UNION SELECT 'DEVELOPED_IN', 'Country', home, name FROM ent),
    nod AS (SELECT DISTINCT target_type AS label, target AS name FROM src),
    men AS (SELECT id, min(name) FILTER (label = 'War') AS war, min(name) FILTER (label = 'Institution') AS maker, min(name) FILTER (label = 'Chassis') AS ride, min(name) FILTER (label = 'Country') AS land
            FROM q LEFT JOIN nod ON contains(qn, {_norm('name')}) GROUP BY id),
    one AS (SELECT relation, target, string_agg(source, '；' ORDER BY source) AS names FROM (SELECT *, row_number() OVER (PARTITION BY relation, target ORDER BY source) AS rn FROM (SELECT DISTINCT relation, target, source FROM src)) WHERE rn <= 15 GROUP BY ALL),
    two AS (SELECT war, maker, string_agg(source, '；' ORDER BY source) AS names FROM (SELECT *, row_number() OVER (PARTITION BY war, maker ORDER BY source) AS rn FROM (SELECT DISTINCT a.target AS war, b.target AS maker, source FROM src a JOIN src b USING (source)
            WHERE a.relation = 'PARTICIPATED_IN' AND b.relation = 'DESIGNED_BY')) WHERE rn <= 12 GROUP BY ALL),
    big AS (SELECT target AS ride, source, k % 240 + 20 AS value FROM src JOIN ent ON source = name WHERE relation = 'USES_CHASSIS' QUALIFY row_number() OVER (PARTITION BY target ORDER BY k % 240 DESC, source) = 1)"""
_ANSWERS = f"""SELECT id, CASE
    WHEN men.war IS NOT NULL AND men.maker IS NOT NULL AND contains(question, '哪') THEN coalesce(men.war || '中由' || men.maker || '设计或生产关联的火炮有: ' || two.names, '当前清洗后的图谱中未检索到同时满足“' || men.war || '”和“' || men.maker || '”条件的火炮。')
    WHEN men.ride IS NOT NULL AND contains(question, '口径最大') THEN coalesce('基于' || men.ride || '的火炮中，口径最大的是 ' || big.source || '，口径约为 ' || value || ' 毫米。', '当前清洗后的图谱中未检索到与 ' || men.ride || ' 相连且带口径属性的火炮。')
    WHEN men.war IS NOT NULL AND contains(question, '哪些') THEN coalesce(men.war || '关联火炮包括: ' || w.names, '当前图谱中没有检索到 ' || men.war || ' 的关联火炮。')
    WHEN men.land IS NOT NULL AND contains(lower(question), 'developed') THEN coalesce(men.land || '研制的火炮示例: ' || l.names, '当前图谱中没有检索到 ' || men.land || ' 研制火炮。')
    ELSE '{v.UNSUPPORTED}' END AS answer
    FROM q JOIN men USING (id) LEFT JOIN two ON two.war = men.war AND two.maker = men.maker LEFT JOIN big ON big.ride = men.ride
    LEFT JOIN one w ON w.relation = 'PARTICIPATED_IN' AND w.target = men.war LEFT JOIN one l ON l.relation = 'DEVELOPED_IN' AND l.target = men.land"""
_LOCAL = """SELECT id, coalesce(name || ' 的局部知识如下。' || nullif(concat_ws(' ', '出边: ' || o.edges, '入边: ' || b.edges), ''), '{unsupported}') AS answer FROM q LEFT JOIN f USING (id)
    LEFT JOIN (SELECT source AS name, string_agg(relation_label || ' -> ' || target, '；' ORDER BY seq) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM e) WHERE rn <= 6 GROUP BY source) o USING (name)
    LEFT JOIN (SELECT target AS name, string_agg(source || ' -> ' || relation_label, '；' ORDER BY seq) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seq) AS rn FROM e) WHERE rn <= 6 GROUP BY target) b USING (name)""".format(unsupported=v.UNSUPPORTED)
_CONTEXT = f"""SELECT id, '{v.ONLY_FOUND}'.replace(chr(10), '') || chr(10) || '【火炮】' || arg_min(name, place) AS head, string_agg(name, ',' ORDER BY place) AS sources, false AS used_model, true AS is_relevant
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, name) AS place FROM top) GROUP BY id
    UNION ALL SELECT -1 - item_id, CASE WHEN item_id % 2 = 0 THEN '{v.IRRELEVANT}' ELSE '{v.ASK}' END, '', false, false FROM benchmark""".replace(f"'{v.ONLY_FOUND}'.replace(chr(10), '')", f"'{v.ONLY_FOUND.strip()}'")

_VERSIONS = """, b AS (SELECT *, ((seq % 3) + (seq // 1000000000) % 3) % 3 + 1 AS batch FROM raw),
    nb AS (SELECT label, name, min(seq % 3 + 1) AS batch FROM ent GROUP BY ALL),
    m AS (SELECT b.*, coalesce(s.batch <= b.batch AND t.batch <= b.batch, false) AS ok FROM b LEFT JOIN nb s ON s.label = source_type AND s.name = source LEFT JOIN nb t ON t.label = target_type AND t.name = target),
    v AS (SELECT unnest([1, 2, 3]) AS version)
    SELECT CAST(version AS BIGINT) AS version, 'node' AS kind, label AS name, count(*) AS n FROM v JOIN nb ON batch <= version GROUP BY ALL
    UNION ALL SELECT version, 'edge', relation, count(*) FROM v JOIN (SELECT relation, source_type, source, target_type, target, min(batch) AS batch FROM m WHERE ok GROUP BY ALL) ON batch <= version GROUP BY ALL
    UNION ALL SELECT version, 'import', 'success', count(batch) FROM v LEFT JOIN m ON batch = version GROUP BY version
    UNION ALL SELECT version, 'import', 'failed', 0 FROM v
    UNION ALL SELECT version, 'import', 'unmatched', count(batch) FILTER (NOT ok) FROM v LEFT JOIN m ON batch = version GROUP BY version"""

QUERIES = {
    "dict_match_items": dict_match_items,
    "questions_topk": questions_topk, "questions_mentions": questions_mentions, "questions_relevance": questions_relevance, "questions_find": questions_find, "answers_bulk": answers_bulk,
    "answers_local_bulk": answers_local, "answers_context_bulk": answers_context_bulk, "store_versions": store_versions, "store_upserted": store_upserted,
    "neighbourhoods": neighbourhoods, "scan_events": scan_events, "ffill_unkeyed": ffill_unkeyed, "range_long": range_long, "edges_from_model": edges_from_model,
}
ORACLES = {
    "dict_match_items": "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE length(word) >= 6) SELECT DISTINCT doc_id, word AS name FROM documents, w WHERE contains(text, word)",
    "questions_topk": _graph("SELECT * FROM top", _QUESTIONS, _TOPK),
    "questions_mentions": _graph("SELECT * FROM men", _QUESTIONS, _MENTIONS),
    "questions_relevance": _graph("SELECT id, CAST(coalesce(s, 0) + 2 * coalesce(m, 0) AS BIGINT) AS score, coalesce(s, 0) + 2 * coalesce(m, 0) >= 3 AS is_relevant FROM q LEFT JOIN (SELECT id, sum(score) AS s FROM top GROUP BY id) USING (id) LEFT JOIN (SELECT id, count(*) AS m FROM men GROUP BY id) USING (id)", _QUESTIONS, _TOPK, _MENTIONS),
    "questions_find": _graph("SELECT * FROM f", _LOOKUPS.replace("{q}", "question")),
    "answers_bulk": rich._sql(_ANSWERS, rich._PARAMETERS, rich._RULES, _INTENTS),
    "answers_local_bulk": _graph(_LOCAL, _LOOKUPS.replace("{q}", "trim(question)")),
    "answers_context_bulk": _graph(_CONTEXT, _QUESTIONS, _TOPK_CUT),
    "neighbourhoods": _graph("SELECT center, source, relation, target FROM num WHERE other = center OR (center, other) IN (SELECT (center, other) FROM tk)", """c AS (SELECT n_name AS center FROM nation UNION ALL SELECT 'part#' || p_partkey FROM part WHERE p_partkey % 100 = 0),
    hop AS (SELECT *, CASE relation WHEN 'DEVELOPED_IN' THEN 1 WHEN 'IS_TYPE_OF' THEN 2 WHEN 'DESIGNED_BY' THEN 3 WHEN 'EQUIPPED_BY' THEN 7 ELSE 99 END AS rk
            FROM (SELECT center, e.*, target AS other, 0 AS side FROM e JOIN c ON source = center UNION ALL SELECT center, e.*, source, 1 FROM e JOIN c ON target = center)),
    num AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY rk, target, source, side, seq) AS rn FROM hop),
    tk AS (SELECT center, other FROM num WHERE other <> center GROUP BY center, other QUALIFY row_number() OVER (PARTITION BY center ORDER BY min(rn)) <= 13)"""),
    "scan_events": """SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER w AS last_error, CAST(sum(CASE WHEN event_type = 'click' THEN 1 END) OVER w AS BIGINT) AS clicks, max(value) OVER w AS highest
        FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "ffill_unkeyed": """SELECT seq, role, last_value(CASE WHEN role <> 'user' THEN role END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
        FROM (SELECT conv_id * 1000 + turn AS seq, min(role) AS role FROM conversations GROUP BY ALL)""",
    "range_long": "SELECT s_name AS name, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n FROM orders ASOF JOIN supplier ON o_orderkey >= s_suppkey * 70 GROUP BY ALL",
    "edges_from_model": "SELECT 'R' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '自行榴弹炮' ELSE '火炮' END AS source, 'USES_CHASSIS' AS relation, '模型底盘' AS target, 'llm' AS method FROM part WHERE p_partkey % 9 = 0 AND NOT contains(CAST(p_partkey AS VARCHAR), '3')",
    "store_versions": f"WITH {GRAPH_SQL}{_VERSIONS}",
    "store_upserted": _graph("SELECT label, name, 'v' || CASE WHEN seq % 3 = 0 THEN 3 WHEN seq % 2 = 0 THEN 2 ELSE 1 END || ' ' || caliber AS caliber, model, page FROM ent WHERE label = 'Artillery'"),
}
