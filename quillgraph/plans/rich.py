"""Parts as entities with texts in the words of the vocabularies, so that every dictionary and every rule has rows to decide.

What a part's text holds follows from its key by arithmetic; the SQL says the same and finds it again by its own joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions import text
from ..operators import boxes, clean, edges, graph, retrieve
from ..sources.held import spread, written
from .star import table


def _k() -> Column:
    return F.col("k")


def _pick(entries, n: Column) -> Column:
    """First keyword of the entry whose place is n modulo the dictionary's length."""
    return F.get(F.array(*(F.lit(words[0]) for _, words in entries)), F.pmod(n, F.lit(len(entries))).cast("int"))


def _text(x: Column) -> Column:
    return x.cast("string")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """seq, name, label, caliber, home, k of each part."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    name = F.concat(F.lit("R"), _text(_k()), F.when(_k() % 5 == 0, "自行榴弹炮").otherwise("火炮"))
    return p.select(_k().alias("seq"), name.alias("name"), F.lit("Artillery").alias("label"), F.concat(_text(_k() % 240 + 20), F.lit(v.UNIT)).alias("caliber"), _pick(v.NATIONS, F.floor(_k() / 2)).alias("home"), "k")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """seq, name, k, text, parameters. A part is a few bytes of its file and a text with a thousand keywords to look for."""
    numbers = F.concat(
        F.lit("口径："), _text(_k() % 240 + 20), F.lit("毫米，射程:1,"), _text(_k() % 900 + 100), F.lit("米，重量 9,"), _text(_k() % 900 + 100), F.lit("千克；射速："), _text(_k() % 9 + 1), F.lit("发／分，全长：9."), _text(_k() % 10), F.lit("米"),
        F.when(_k() % 2 == 0, F.concat(F.lit("，炮管长:5."), _text(_k() % 7), F.lit("米，全宽：3米，全高：2.5米"))).otherwise(""),
    )
    body = F.concat(
        F.when(_k() % 7 != 0, _pick(v.WARS, _k())).otherwise("和平时期"), F.lit("使用，"), _pick(v.INSTITUTIONS, _k()), F.lit("生产，"), F.when(_k() % 4 == 0, _pick(v.DESIGNERS, F.floor(_k() / 4))).otherwise("佚名"), F.lit("设计。"),
        _pick(v.CHASSIS, _k()), F.lit("；"), _pick(v.AMMUNITION, _k()), F.lit("；"), _pick(v.SUBTYPES, _k()), F.lit("。"), numbers,
        F.lit("\n衍生型号\nR"), _text(_k()), F.lit("A  改进\nR"), _text(_k() + 1), F.lit("B\t说明\n火炮"), _text(_k()), F.lit("  无\nR"), _text(_k()), F.lit("  基型\n服役记录 "), _pick(v.NATIONS, _k()), F.lit("，"), _pick(v.BRANCHES, _k()),
    )
    rows = spread(entities(spark, sf), "k").withColumn("text", body)
    return rows.select("seq", "name", "k", "text", text.parameters(F.col("text")).alias("parameters"))


def rule_record(spark: SparkSession, sf: str) -> DataFrame:
    found = edges.rule_record(docs(spark, sf))
    return found.select("name", *(F.array_join(c, "/").alias(c) for c in ("wars", "institutions", "chassis", "ammunition", "designers", "nations", "subtypes", "branches")))


def param_map(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("name", F.explode("parameters").alias("key", "value"))


def rule_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edges.rule_edges(docs(spark, sf)).select("source", "source_type", "relation", "target", "target_type", "method", "description")


def _base(spark: SparkSession, sf: str) -> DataFrame:
    to = lambda k, r, t, kind: F.struct(F.array(_k(), F.lit(k).cast("long")).alias("seq"), F.lit(r).alias("relation"), t.alias("target"), F.lit(kind).alias("target_type"))
    both = F.explode(F.array(to(0, "DEVELOPED_IN", F.col("home"), "Country"), to(1, "IS_TYPE_OF", F.when(_k() % 5 == 0, "榴弹炮").otherwise("迫击炮"), "Category"))).alias("e")
    return entities(spark, sf).select("name", both).select("e.seq", F.col("name").alias("source"), F.lit("Artillery").alias("source_type"), "e.relation", "e.target", "e.target_type", F.lit("base").alias("method"), F.lit("").alias("description"))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    """Clean edges of all eight relations: from texts by rules, and some from a model whose chassis are no chassis."""
    own = entities(spark, sf)
    replies = lambda prompts: [f'{{"relations": [{{"source": "{p}", "source_type": "Artillery", "relation": "USES_CHASSIS", "target": "坦克", "target_type": "Chassis"}}]}}' for p in prompts]
    asked = edges.model_edges(own.where(_k() % 9 == 0), replies, "name").withColumns({"method": F.lit("llm"), "description": F.lit("")})
    deep = edges.rule_edges(docs(spark, sf)).unionByName(asked)
    return clean.clean_edges(_base(spark, sf), deep, own.where(_k() % 11 != 0).select("name"), own.select("seq", "name", "home"))


def clean_edges_all(spark: SparkSession, sf: str) -> DataFrame:
    return _kept(spark, sf).select("source", "relation", "target", "method")


def clean_entities_all(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_entities(_kept(spark, sf).where("method <> 'base'"))


def _graph(spark: SparkSession, sf: str) -> graph.Graph:
    return graph.build(entities(spark, sf).select("seq", "name", "label", "caliber"), _kept(spark, sf), once=True)


QUESTIONS = {
    "both": "二战中哪些火炮由克虏伯设计？", "largest": "基于M4谢尔曼底盘的火炮，口径最大的是什么", "war": "海湾战争有哪些火炮", "land": "德国研制了什么", "none": "你好", "empty": " ",
}


def answers(spark: SparkSession, sf: str) -> DataFrame:
    g = _graph(spark, sf)
    return spark.createDataFrame([(k, retrieve.answer(g, q)) for k, q in QUESTIONS.items()], "question string, answer string")


def answers_with_context(spark: SparkSession, sf: str) -> DataFrame:
    g, texts = _graph(spark, sf), docs(spark, sf).select("name", "text")
    rows = [("irrelevant", retrieve.answer_with_context(g, texts, "zz")), ("model", retrieve.answer_with_context(g, texts, "R7火炮", model=lambda q, c: f"{q}|{len(c)}|{c[0][:9]}"))]
    return spark.createDataFrame([(k, a["answer"], ",".join(a["sources"]), a["used_model"], a["is_relevant"]) for k, a in rows], "question string, answer string, sources string, used_model boolean, is_relevant boolean")


def nodes_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Three rows for each name: the second has an empty or no value, the third another one for some; the labels differ."""
    rows = entities(spark, sf).select("k", "name", "label", "caliber")
    more = F.when(_k() % 3 == 0, F.lit("")).when(_k() % 3 == 1, F.concat(F.lit("c"), _text(_k())))
    second = rows.select("k", "name", F.lit("Country").alias("label"), more.alias("caliber"))
    third = rows.where(_k() % 2 == 0).select("k", "name", F.lit("War").alias("label"), F.lit("last").alias("caliber"))
    numbered = [r.withColumn("seq", _k() * 3 + n) for n, r in enumerate((rows, second, third))]
    return graph.merged_nodes(numbered[0].unionByName(numbered[1]).unionByName(numbered[2]).drop("k")).select("name", "label", "caliber")


#: Pages of ink in a partition, 800 rows each.
PAGES = 2000


def main_picture(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of ten parts each: every fourth has a picture block, an area, a band of ink, or none of these."""
    d = lambda x: x.cast("double")
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 10).alias("page"), F.col("p_partkey").alias("seq"), "p_size")
    size = {"width": F.lit(600.0), "height": F.lit(800.0), "pixel_width": F.lit(600), "pixel_height": F.lit(800)}
    pages = spread(p.select("page").distinct(), "page", parts=p.count() // 10 // PAGES).withColumns(size)
    boxed = p.select("page", "seq", "p_size", (F.col("seq") % 300).alias("x"), (F.col("seq") % 500).alias("y"), (F.col("p_size") * 8).alias("w"), (F.col("p_size") * 6).alias("h"))
    blocks = boxed.where("page % 4 = 0").select("page", "seq", (F.col("seq") % 2).alias("kind"), d(F.col("x")).alias("x0"), d(F.col("y")).alias("y0"), d(F.col("x") + F.col("w")).alias("x1"), d(F.col("y") + F.col("h")).alias("y1"))
    areas = boxed.where("page % 4 = 1").select("page", "seq", "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"), d(F.col("p_size")).alias("spread"))
    dark = F.when(F.col("y").between(100 + F.col("page") % 50, 300 + F.col("page") % 200), 50 + F.col("y") % 5).otherwise(F.col("y") % 3)
    ink = pages.where("page % 4 = 2").select("page", F.explode(F.sequence(F.lit(0), F.lit(799))).alias("y")).select("page", "y", F.pmod(F.col("y") + F.col("page"), F.lit(600)).cast("int").alias("x"), dark.cast("int").alias("n"))
    return boxes.main_pictures(pages, blocks, areas, ink)


def book_pages(spark: SparkSession, sf: str) -> DataFrame:
    books = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("book"), (F.col("s_suppkey") * 7 % 400).cast("int").alias("n_pages"))
    return boxes.wanted_pages(books).groupBy("book").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n"))


# ---- the same in SQL

_DICTIONARIES = [("wars", v.WARS), ("institutions", v.INSTITUTIONS), ("designers", v.DESIGNERS), ("chassis", v.CHASSIS), ("ammunition", v.AMMUNITION), ("nations", v.NATIONS), ("subtypes", v.SUBTYPES), ("branches", v.BRANCHES)]


def _list(entries) -> str:
    return "[" + ", ".join(f"'{words[0]}'" for _, words in entries) + "]"


def _at(entries, n: str) -> str:
    return f"{_list(entries)}[CAST(({n}) % {len(entries)} AS INT) + 1]"


_WORDS = ", ".join(f"('{kind}', {n}, '{name}', '{word}')" for kind, entries in _DICTIONARIES for n, (name, words) in enumerate(entries) for word in words)
_DOCS = f"""ent AS (SELECT p_partkey AS k, 'R' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '自行榴弹炮' ELSE '火炮' END AS name, (p_partkey % 240 + 20) || '毫米' AS caliber, {_at(v.NATIONS, "p_partkey // 2")} AS home FROM part),
    doc AS (SELECT *, CASE WHEN k % 7 <> 0 THEN {_at(v.WARS, "k")} ELSE '和平时期' END || '使用，' || {_at(v.INSTITUTIONS, "k")} || '生产，' || CASE WHEN k % 4 = 0 THEN {_at(v.DESIGNERS, "k // 4")} ELSE '佚名' END || '设计。'
            || {_at(v.CHASSIS, "k")} || '；' || {_at(v.AMMUNITION, "k")} || '；' || {_at(v.SUBTYPES, "k")} || '。' AS head, '服役记录 ' || {_at(v.NATIONS, "k")} || '，' || {_at(v.BRANCHES, "k")} AS tail FROM ent),
    word(kind, ord, name, word) AS (VALUES {_WORDS}),
    rec AS (SELECT DISTINCT k, doc.name AS source, kind, ord, word.name AS target FROM doc, word
            WHERE CASE kind WHEN 'nations' THEN contains(tail, word) WHEN 'subtypes' THEN contains(head || chr(10) || tail || chr(10) || doc.name, word) ELSE contains(head || chr(10) || tail, word) END)"""
_PARAMETERS = """par AS (SELECT name, key, value FROM (
    SELECT k, name, unnest(['caliber', 'range', 'weight', 'rate_of_fire', 'length', 'barrel_length', 'width', 'height']) AS key,
           unnest([CAST(k % 240 + 20 AS VARCHAR), '1' || (k % 900 + 100), '9' || (k % 900 + 100), CAST(k % 9 + 1 AS VARCHAR), '9.' || (k % 10), '5.' || (k % 7), '3', '2.5']) AS value FROM ent)
    WHERE k % 2 = 0 OR key NOT IN ('barrel_length', 'width', 'height'))"""
_RULES = """rule AS (
    SELECT source, 'Artillery' AS source_type, CASE kind WHEN 'wars' THEN 'PARTICIPATED_IN' WHEN 'institutions' THEN 'DESIGNED_BY' WHEN 'designers' THEN 'DESIGNED_BY' WHEN 'chassis' THEN 'USES_CHASSIS'
           WHEN 'ammunition' THEN 'USES_AMMO' WHEN 'nations' THEN 'EQUIPPED_BY' WHEN 'subtypes' THEN 'IS_SUBTYPE_OF' ELSE 'SERVED_IN' END AS relation, target,
           CASE kind WHEN 'wars' THEN 'War' WHEN 'institutions' THEN 'Institution' WHEN 'designers' THEN 'Designer' WHEN 'chassis' THEN 'Chassis' WHEN 'ammunition' THEN 'Ammunition' WHEN 'nations' THEN 'Country'
           WHEN 'subtypes' THEN 'SubCategory' ELSE 'MilitaryBranch' END AS target_type, 'rule' AS method, '' AS description FROM rec
    UNION ALL SELECT name, 'Artillery', 'HAS_PROPERTY', CASE key WHEN 'caliber' THEN '口径' WHEN 'range' THEN '射程' WHEN 'weight' THEN '重量' WHEN 'rate_of_fire' THEN '射速' WHEN 'length' THEN '全长' WHEN 'barrel_length' THEN '炮管长'
           WHEN 'width' THEN '全宽' ELSE '全高' END || '=' || value, 'Property', 'rule', '' FROM par
    UNION ALL SELECT unnest(['R' || k || 'A', 'R' || (k + 1) || 'B', '火炮' || k, 'R' || k]), 'Derivative', 'DERIVED_FROM', name, 'Artillery', 'rule', unnest(['改进', '说明', '无', '基型']) FROM ent),
    kept AS (SELECT DISTINCT source, source_type, relation, target, target_type, method FROM rule JOIN ent ON ent.name = CASE relation WHEN 'DERIVED_FROM' THEN target ELSE source END
             WHERE CASE relation WHEN 'IS_SUBTYPE_OF' THEN false WHEN 'SERVED_IN' THEN false WHEN 'HAS_PROPERTY' THEN false WHEN 'EQUIPPED_BY' THEN target <> home WHEN 'PARTICIPATED_IN' THEN list_contains({wars}, target)
             WHEN 'DERIVED_FROM' THEN NOT contains(source, '火炮') AND source <> 'R' || k AND k % 11 <> 0 ELSE true END),
    named AS (SELECT source, relation, target, target_type, min(method) AS method FROM kept GROUP BY ALL)""".format(wars="[" + ", ".join(f"'{w}'" for w in v.VALID_WARS) + "]")


def _sql(select: str, *more: str) -> str:
    return f"WITH {', '.join((_DOCS, *more))} {select}"


def _joined(kind: str) -> str:
    return f"coalesce(string_agg(rec.target, '/' ORDER BY ord) FILTER (kind = '{kind}'), '') AS {kind}"


def _first(n: int, where: str) -> str:
    return f"(SELECT string_agg(source, '；' ORDER BY source) FROM (SELECT DISTINCT source FROM ({where}) ORDER BY source LIMIT {n}))"


_BOTH = _first(12, "SELECT source FROM kept WHERE relation = 'PARTICIPATED_IN' AND target = '二战' INTERSECT SELECT source FROM kept WHERE relation = 'DESIGNED_BY' AND target = '克虏伯'")
_WAR = _first(15, "SELECT source FROM kept WHERE relation = 'PARTICIPATED_IN' AND target = '海湾战争'")
_LAND = _first(15, "SELECT name AS source FROM ent WHERE home = '德国'")
ORACLES = {
    "rule_record": _sql("SELECT ent.name, " + ", ".join(map(_joined, ("wars", "institutions", "chassis", "ammunition", "designers", "nations", "subtypes", "branches"))) + " FROM ent LEFT JOIN rec USING (k) GROUP BY ent.name"),
    "param_map": _sql("SELECT name, key, value FROM par", _PARAMETERS),
    "rule_edges": _sql("SELECT * FROM rule", _PARAMETERS, _RULES),
    "clean_edges_all": _sql("SELECT source, relation, target, method FROM named UNION ALL SELECT name, 'DEVELOPED_IN', home, 'base' FROM ent UNION ALL SELECT name, 'IS_TYPE_OF', CASE WHEN k % 5 = 0 THEN '榴弹炮' ELSE '迫击炮' END, 'base' FROM ent", _PARAMETERS, _RULES),
    "clean_entities_all": _sql("SELECT source_type AS label, source AS name FROM kept WHERE source_type = 'Derivative' UNION SELECT target_type, target FROM kept WHERE target_type NOT IN ('Artillery', 'Category')", _PARAMETERS, _RULES),
    "answers": _sql(
        f"""SELECT 'both' AS question, coalesce('二战中由克虏伯设计或生产关联的火炮有: ' || {_BOTH}, '当前清洗后的图谱中未检索到同时满足“二战”和“克虏伯”条件的火炮。') AS answer
        UNION ALL SELECT 'largest', (SELECT '基于M4谢尔曼底盘的火炮中，口径最大的是 ' || name || '，口径约为 ' || (k % 240 + 20) || ' 毫米。' FROM kept JOIN ent ON source = name WHERE relation = 'USES_CHASSIS' AND target = 'M4谢尔曼底盘' ORDER BY k % 240 DESC, name LIMIT 1)
        UNION ALL SELECT 'war', coalesce('海湾战争关联火炮包括: ' || {_WAR}, '当前图谱中没有检索到 海湾战争 的关联火炮。')
        UNION ALL SELECT 'land', coalesce('德国研制的火炮示例: ' || {_LAND}, '当前图谱中没有检索到 德国 研制火炮。')
        UNION ALL SELECT 'none', '{retrieve.UNSUPPORTED}' UNION ALL SELECT 'empty', '请输入问题。'""", _PARAMETERS, _RULES),
    "answers_with_context": _sql(f"SELECT 'irrelevant' AS question, '{retrieve.IRRELEVANT}' AS answer, '' AS sources, false AS used_model, false AS is_relevant UNION ALL SELECT 'model', 'R7火炮|' || (1 + count(*)) || '|【火炮】R7火炮' || chr(10), concat_ws(',', 'R7火炮', string_agg(name, ',' ORDER BY name)), true, true FROM (SELECT name FROM ent WHERE k <> 7 AND (starts_with(k::VARCHAR, '7') OR starts_with((k + 1)::VARCHAR, '7')) ORDER BY name LIMIT 3)"),
    "nodes_repeated": _sql("SELECT name, 'Artillery' AS label, CASE WHEN k % 2 = 0 THEN 'last' WHEN k % 3 = 1 THEN 'c' || k ELSE caliber END AS caliber FROM ent"),
    "book_pages": "SELECT s_suppkey AS book, 12 AS first, CAST(least(367, s_suppkey * 7 % 400) AS INT) AS last, least(367, s_suppkey * 7 % 400) - 11 AS n FROM supplier WHERE s_suppkey * 7 % 400 >= 12",
    "main_picture": """WITH p AS (SELECT p_partkey // 10 AS page, p_partkey AS seq, p_partkey % 300 AS x, p_partkey % 500 AS y, p_size * 8 AS w, p_size * 6 AS h, p_size FROM part), g AS (SELECT DISTINCT page FROM p),
    b AS (SELECT page, 'image_block' AS method, x AS x0, y AS y0, x + w AS x1, y + h AS y1, row_number() OVER (PARTITION BY page ORDER BY 100.0 * w * h / 480000 + CASE WHEN (y + h / 2.0) / 800 BETWEEN 0.18 AND 0.78 THEN 20 ELSE 0 END + CASE WHEN w / h::DOUBLE BETWEEN 1.0 AND 3.8 THEN 10 ELSE 0 END
          - CASE WHEN y < 64 THEN 8 ELSE 0 END - CASE WHEN y + h > 736 THEN 8 ELSE 0 END DESC, seq) AS n FROM p WHERE page % 4 = 0 AND seq % 2 = 1 AND w >= 108 AND h >= 80 AND w * h / 480000.0 <= 0.88
          AND 100.0 * w * h / 480000 + CASE WHEN (y + h / 2.0) / 800 BETWEEN 0.18 AND 0.78 THEN 20 ELSE 0 END + CASE WHEN w / h::DOUBLE BETWEEN 1.0 AND 3.8 THEN 10 ELSE 0 END - CASE WHEN y < 64 THEN 8 ELSE 0 END - CASE WHEN y + h > 736 THEN 8 ELSE 0 END >= 0),
    a AS (SELECT page, 'page_photo_component' AS method, greatest(x - w * 2 // 100, 0) AS x0, greatest(y - h * 3 // 100, 0) AS y0, least(x + w + w * 2 // 100, 600) AS x1, least(y + h + h * 3 // 100, 800) AS y1, row_number() OVER (PARTITION BY page ORDER BY 100.0 * w * h / 480000 + CASE WHEN w / h::DOUBLE BETWEEN 1.1 AND 3.8 THEN 18 ELSE 0 END
          + CASE WHEN y < 464 THEN 20 ELSE 0 END + CASE WHEN p_size > 28 THEN 18 WHEN p_size > 18 THEN 8 ELSE 0 END + CASE WHEN w > 270 THEN 8 ELSE 0 END + CASE WHEN h > 96 THEN 8 ELSE 0 END - CASE WHEN x < 24 OR x + w > 576 THEN 6 ELSE 0 END - CASE WHEN y < 40 THEN 6 ELSE 0 END DESC, seq) AS n
          FROM p WHERE page % 4 = 1 AND NOT (w < 132 OR h < 64 OR w * h / 480000.0 < 0.03 OR y > 624)),
    f AS (SELECT * FROM b WHERE n = 1 UNION ALL SELECT * FROM a WHERE n = 1),
    c AS (SELECT page, 'page_density_crop' AS method, 100 + page % 50 AS lo, 300 + page % 200 AS hi FROM g WHERE page % 4 = 2),
    cx AS (SELECT *, (lo - 20 + page) % 600 AS s, (hi + 19 + page) % 600 AS e FROM c),
    ink AS (SELECT page, (y + page) % 600 AS x, CASE WHEN y BETWEEN lo AND hi THEN 50 + y % 5 ELSE y % 3 END AS v FROM c, range(800) t(y) WHERE y >= lo - 20 AND y < hi + 20),
    col AS (SELECT page, x, sum(v) AS v FROM ink GROUP BY page, x), dense AS (SELECT *, x - row_number() OVER (PARTITION BY page ORDER BY x) AS r FROM (SELECT *, max(v) OVER (PARTITION BY page) AS m FROM col) WHERE m > 0 AND v >= 0.22 * m),
    run AS (SELECT page, min(x) AS a, max(x) AS z FROM dense GROUP BY page, r HAVING max(x) - min(x) + 1 >= 120), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY z - a DESC, a) AS n FROM run) WHERE n = 1),
    d AS (SELECT page, method, coalesce(greatest(a - 20, 0), 48) AS x0, lo - 20 AS y0, coalesce(least(z + 20, 600), 552) AS x1, hi + 20 AS y1 FROM c LEFT JOIN top USING (page))
    SELECT page, coalesce(f.method, d.method, 'page_density_fallback') AS method, CAST(coalesce(f.x0, d.x0, 0) AS DOUBLE) AS x0, CAST(coalesce(f.y0, d.y0, 128) AS DOUBLE) AS y0, CAST(coalesce(f.x1, d.x1, 600) AS DOUBLE) AS x1, CAST(coalesce(f.y1, d.y1, 544) AS DOUBLE) AS y1
    FROM g LEFT JOIN f USING (page) LEFT JOIN d USING (page)""",
}
QUERIES = {
    "rule_record": rule_record, "param_map": param_map, "rule_edges": rule_edges, "clean_edges_all": clean_edges_all, "clean_entities_all": clean_entities_all, "answers": answers, "answers_with_context": answers_with_context,
    "nodes_repeated": nodes_repeated, "main_picture": main_picture, "book_pages": book_pages,
}
