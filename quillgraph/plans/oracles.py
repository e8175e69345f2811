"""SQL that DuckDB runs over the same tables, for each query that SQL can express."""

from __future__ import annotations

from . import bulk, rich
from .star import GRAPH_SQL

_Q = "is part#7 of brand#7 in the promo range, as nation_3 says of thble?"
_QN = _Q.replace(" ", "")
_NORM = r"lower(regexp_replace({}, '[\s\x{{3000}}\x{{00A0}}]+', '', 'g'))"
_WORDS = "(VALUES ('alpha', 'thble'), ('alpha', 'thtion'), ('beta', 'attion'), ('beta', 'ertion'), ('gamma', 'nicht'), ('gamma', 'thing'), ('delta', 'eriner'), ('delta', 'thanea'), ('none', 'zzzz'){}) AS w(name, word)"


def norm(x: str) -> str:
    return _NORM.format(x)


def graph(sql: str, more: str = "") -> str:
    return f"WITH {GRAPH_SQL}{', ' + more if more else ''} {sql}"


_SCORES = f"""hit AS (SELECT source AS name, count(*) * 5 AS edges FROM e WHERE contains('{_QN}', {norm('target')}) GROUP BY source),
    txt AS (SELECT 'part#' || doc_id AS name, text FROM documents),
    own AS (SELECT n.name, category, caliber, model, range, weight, text,
            {norm("concat_ws(' ', n.name, coalesce(model, ''), coalesce(core_model, ''), coalesce(category, ''), substr(coalesce(text, ''), 1, 1800))")} AS s FROM n LEFT JOIN txt USING (name) WHERE label = 'Artillery'),
    tok AS (SELECT unnest(regexp_extract_all('Is part#7 of Brand#7 in the PROMO range, as nation_3 says of thble?', '[A-Za-z0-9][A-Za-z0-9\\-]*')) AS t),
    sc AS (SELECT own.name, CASE WHEN contains('{_QN}', {norm('own.name')}) THEN 12 ELSE 0 END + CASE WHEN coalesce(model, '') <> '' AND contains('{_QN}', {norm('model')}) THEN 8 ELSE 0 END
           + coalesce((SELECT sum(CASE WHEN length(t) > 2 THEN 2 ELSE 1 END) FROM tok WHERE contains(s, lower(t))), 0) + coalesce(edges, 0) AS score FROM own LEFT JOIN hit USING (name)),
    top AS (SELECT name, CAST(score AS BIGINT) AS score FROM sc WHERE score > 0 ORDER BY score DESC, name LIMIT 4),
    men AS (SELECT label, name FROM n WHERE contains('{_QN}', {norm('name')})),
    rel AS (SELECT source AS name, string_agg(relation_label || '->' || target, '；' ORDER BY seq) AS rels FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq) AS rn FROM e) WHERE rn <= 12 GROUP BY source),
    ctx AS (SELECT top.name, top.score,
            CASE WHEN concat_ws('', category, caliber, range, weight) = '' THEN '无' ELSE concat_ws('；', '类别: ' || nullif(category, ''), '口径: ' || nullif(caliber, ''), '射程: ' || nullif(range, ''), '重量: ' || nullif(weight, '')) END AS facts,
            coalesce(rels, '无') AS rels, coalesce(nullif(substr(text, 1, 1200), ''), '无') AS body FROM top JOIN own USING (name) LEFT JOIN rel USING (name))"""
_HOP = """hop AS (SELECT *, CASE relation WHEN 'DEVELOPED_IN' THEN 1 WHEN 'IS_TYPE_OF' THEN 2 WHEN 'DESIGNED_BY' THEN 3 WHEN 'EQUIPPED_BY' THEN 7 ELSE 99 END AS rk
          FROM (SELECT *, target AS other, 0 AS side FROM e WHERE source = '{c}' UNION ALL SELECT *, source, 1 FROM e WHERE target = '{c}')),
    num AS (SELECT *, row_number() OVER (ORDER BY rk, target, source, side, seq) AS rn FROM hop),
    tk AS (SELECT other FROM num WHERE other <> '{c}' GROUP BY other ORDER BY min(rn) LIMIT {k})"""
_FLOAT = r"CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({x} AS DOUBLE) END"
_PRF = """SELECT {by} round(coalesce(tp / nullif(m, 0), 0), 4) AS precision, round(coalesce(tp / nullif(g, 0), 0), 4) AS recall,
    round(coalesce(2 * (tp / nullif(m, 0)) * (tp / nullif(g, 0)) / nullif(tp / nullif(m, 0) + tp / nullif(g, 0), 0), 0), 4) AS f1, tp, m - tp AS fp, g - tp AS fn, g AS gold_count, m AS machine_count"""
_SETS = """gold AS (SELECT * FROM raw WHERE relation <> 'SUPPLIED_BY' AND (relation <> 'EQUIPPED_BY' OR seq % 3 > 0)),
    gt AS (SELECT DISTINCT source, relation, target FROM gold), mt AS (SELECT DISTINCT source, relation, target FROM raw),
    ge AS (SELECT source_type AS label, source AS name FROM gold UNION SELECT target_type, target FROM gold UNION SELECT label, name FROM ent WHERE label <> 'Supplier' AND seq % 3 > 0),
    me AS (SELECT source_type AS label, source AS name FROM raw UNION SELECT target_type, target FROM raw UNION SELECT label, name FROM ent)"""
_TITLES = """t AS (SELECT p_partkey, ['德国', '苏联', '英国/德国/意大利', 'Atlantis'][CAST(p_partkey % 4 AS INT) + 1] AS land, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 240) || '毫米' ELSE '' END AS cal,
          ['榴弹炮', '自行火箭炮', '多管迫击炮', '船'][CAST((p_partkey // 4) % 4 AS INT) + 1] AS kind FROM part),
    s AS (SELECT *, land || cal || 'M' || p_partkey || kind AS name, 'M' || p_partkey || CASE kind WHEN '自行火箭炮' THEN '自行' WHEN '多管迫击炮' THEN '多管' ELSE '' END AS model,
          CASE kind WHEN '榴弹炮' THEN '榴弹炮' WHEN '自行火箭炮' THEN '火箭炮' ELSE '迫击炮' END AS kd FROM t WHERE land <> 'Atlantis' AND kind <> '船')"""
_RINGS = """lab AS (SELECT label, count(*) AS total, CASE label WHEN 'Country' THEN 0 WHEN 'Category' THEN 1 WHEN 'Institution' THEN 2 ELSE 8 END AS pl,
    CASE label WHEN 'Country' THEN 1.2 WHEN 'Category' THEN 2.1 WHEN 'Institution' THEN 3.0 ELSE 6.2 END AS radius FROM n {w} GROUP BY label),
    ix AS (SELECT name, label, row_number() OVER (PARTITION BY label ORDER BY place) - 1 AS idx FROM n {w}),
    pos AS (SELECT name, label, {r} * cos({a}) AS x, {r} * sin({a}) AS y FROM ix JOIN (SELECT *, row_number() OVER (ORDER BY pl) AS ring FROM lab) USING (label))"""
_GLOBAL = _RINGS.format(w="", r="(radius + 0.18 * (idx % 5 - 2))", a="(2 * pi() * idx / total + 0.37 * pl)")
_AROUND = _RINGS.format(w="WHERE name <> 'NATION_3'", r="(1.2 * ring)", a="(2 * pi() * idx / total)")
_BOX = """b AS (SELECT p_partkey // 10 AS grp, p_partkey AS seq, CAST(p_partkey % 300 AS DOUBLE) AS x0, CAST(p_partkey % 500 AS DOUBLE) AS y0, CAST(p_size * 8 AS DOUBLE) AS bw, CAST(p_size * 6 AS DOUBLE) AS bh, p_size FROM part),
    sb AS (SELECT *, round(CASE WHEN greatest(bw, 1) < 108 OR greatest(bh, 1) < 80 OR greatest(bw, 1) * greatest(bh, 1) / 480000 > 0.88 THEN -1.0
           ELSE 100 * (greatest(bw, 1) * greatest(bh, 1) / 480000) + CASE WHEN (y0 + y0 + bh) / 2 / 800 BETWEEN 0.18 AND 0.78 THEN 20 ELSE 0 END + CASE WHEN greatest(bw, 1) / greatest(bh, 1) BETWEEN 1.0 AND 3.8 THEN 10 ELSE 0 END
           - CASE WHEN y0 < 64 THEN 8 ELSE 0 END - CASE WHEN y0 + bh > 736 THEN 8 ELSE 0 END END, 4) AS score FROM b)"""
_NUM = "round(CAST({} AS DOUBLE), 2)"
_PROFILE = """vals AS (SELECT name, 0 AS ord, 'caliber' AS key, TRY_CAST(replace(caliber, '毫米', '') AS DOUBLE) AS value, 240.0 AS most FROM n UNION ALL SELECT name, 1, 'range', TRY_CAST(replace(range, '米', '') AS DOUBLE), 45000.0 FROM n
    UNION ALL SELECT name, 2, 'weight', TRY_CAST(weight AS DOUBLE), 50000.0 FROM n),
    prof AS (SELECT name, ord, key, value, round(value, 2) AS display_value, round(least(greatest(value / most * 100, 0.0), 100.0), 1) AS score, CAST(most AS DOUBLE) AS max_value FROM vals WHERE value IS NOT NULL)"""
_BARE = "replace(replace(raw, ',', ''), '米', '')"
_KM = "replace(replace(replace(raw, ',', ''), '千米', '000'), '米', '')"
_CJK = "length(regexp_replace(x, '[^一-龥]', '', 'g'))"
_OK = r"x <> '' AND length(x) <= 24 AND NOT regexp_matches(x, '{}') AND NOT regexp_full_match(x, '[0-9]{{4,}}') AND " + _CJK + r" <= 6 AND regexp_matches(x, '[A-Za-z0-9]')"

ORACLES: dict[str, str] = {
    "stats_relations": graph("SELECT relation, count(*) AS n FROM e GROUP BY relation"),
    "stats_labels": graph("SELECT label, count(*) AS n FROM n GROUP BY label"),
    "stats_totals": graph("SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges"),
    "stats_categories": graph("SELECT category, count(*) AS n FROM n WHERE category <> '' GROUP BY category ORDER BY n DESC, min(name) LIMIT 12"),
    "stats_top_targets": graph("SELECT target, count(*) AS n FROM e WHERE relation = 'EQUIPPED_BY' GROUP BY target ORDER BY n DESC, min({'s': source, 'q': seq}) LIMIT 12"),
    "stats_names": graph("SELECT DISTINCT label, name FROM n"),
    "graph_nodes": graph("SELECT kind, entity, edge, \"end\", name, label, category, caliber, model, core_model, page, range, weight FROM n"),
    "graph_nodes_full": graph("SELECT kind, entity, edge, \"end\", name, label, category, caliber, model, core_model, page, range, weight FROM fn"),
    "graph_edges": graph("SELECT seq, source, relation, relation_label, target, source_type, target_type, method FROM fe"),
    "graph_edges_trusted": graph("SELECT seq, source, relation, relation_label, target, source_type, target_type, method FROM e"),
    "one_hop": graph("SELECT seq, source, relation, target FROM num WHERE other IN (SELECT other FROM tk) OR other = 'NATION_3'", _HOP.format(c="NATION_3", k=13)),
    "one_hop_nodes": graph("SELECT name, label FROM n WHERE name = 'part#7' OR name IN (SELECT other FROM tk)", _HOP.format(c="part#7", k=5)),
    "relation_groups": graph("SELECT relation_label, string_agg(DISTINCT target, ',' ORDER BY target) AS members FROM e WHERE source = 'part#7' GROUP BY relation_label"),
    "degree": graph("SELECT name, (SELECT count(*) FROM fe WHERE source = name) AS n_out, (SELECT count(*) FROM fe WHERE target = name) AS n_in FROM fn"),
    "related": graph("SELECT source AS name FROM e WHERE target = 'NATION_3' AND source_type = 'Artillery' UNION SELECT target FROM e WHERE source = 'NATION_3' AND target_type = 'Artillery'"),
    "reach": graph("SELECT 'part#7' AS name, 0 AS hop UNION ALL SELECT DISTINCT target, 1 FROM fe WHERE source = 'part#7'"),
    "fuzzy_find": graph(f"SELECT name FROM n WHERE contains({norm('name')}, 'part#12') ORDER BY CASE WHEN {norm('name')} = 'part#12' THEN 1 ELSE 2 END, place LIMIT 1"),
    "fuzzy_find_label": graph(f"SELECT name FROM n WHERE label = 'Country' AND contains({norm('name')}, '_1') ORDER BY name LIMIT 1"),
    "label_match": graph(f"SELECT name FROM n WHERE label = 'Country' AND contains('{_QN}', {norm('name')}) ORDER BY name LIMIT 1"),
    "category_filter": graph("SELECT coalesce(nullif(category, ''), '未知') AS category, count(*) AS n FROM n GROUP BY 1"),
    "suggestions": graph("SELECT name, min(ord) AS ord FROM (SELECT name, ord FROM (VALUES ('part#3', 0), ('nobody', 1), ('part#1', 2)) AS v(name, ord) WHERE name IN (SELECT name FROM n) UNION ALL SELECT name, 3 + row_number() OVER (ORDER BY name) FROM (SELECT name FROM n WHERE label = 'Artillery' ORDER BY name LIMIT 8)) GROUP BY name"),
    "dict_match": f"SELECT DISTINCT doc_id, name FROM documents, {_WORDS.format('')} WHERE contains(text, word)",
    "dict_match_large": f"SELECT DISTINCT doc_id, name FROM documents, {_WORDS.format('')} WHERE contains(text, word)",
    "dict_match_two_fields": f"SELECT DISTINCT doc_id, name FROM documents, {_WORDS.format(chr(44) + ' (' + chr(39) + 'one' + chr(39) + ', ' + chr(39) + 'src1' + chr(39) + ')')} WHERE contains(text, word) OR contains(source, word)",
    "dict_match_section": f"SELECT DISTINCT doc_id, name FROM documents, {_WORDS.format('')} WHERE strpos(text, 'and') > 0 AND contains(substr(text, strpos(text, 'and'), 500), word)",
    "param_extract": r"SELECT doc_id, nullif(replace(regexp_extract(text, '([0-9][0-9,]*)', 1), ',', ''), '') AS first_number, nullif(replace(regexp_extract(text, 'the[：:\s]*([a-z]+)', 1), ',', ''), '') AS after_the, nullif(regexp_extract(text, '([0-9]{16})', 1), '') AS card FROM documents",
    "tokenize": r"SELECT token, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, unnest(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9\-]*|[一-龥]{2,}')) AS token FROM documents) WHERE token NOT IN ('The', 'the', 'of') GROUP BY token",
    "normalize_name": f"SELECT doc_id, md5({norm('text')}) AS md5, substr(md5(text), 1, 12) AS file FROM documents",
    "safe_float": "WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '1,' ELSE '' END || p_size || ['米', '千米', ' ', 'x', '.5米', 'e2'][CAST(p_partkey % 6 AS INT) + 1] AS raw FROM part), "
    f"b AS (SELECT *, trim({_BARE}) AS a, trim({_KM}) AS k FROM r) SELECT p_partkey, raw, {_FLOAT.format(x='a')} AS value, {_FLOAT.format(x='k')} AS in_metres FROM b",
    "title_split": f"WITH {_TITLES} SELECT p_partkey, name, land AS countries, cal AS caliber, model, kd AS kind, CASE WHEN kind = '榴弹炮' THEN '' ELSE substr(kind, 1, 2) END AS subtype, 'M' || p_partkey AS core_model FROM s",
    "outline_edges": f"WITH {_TITLES}, c AS (SELECT *, ['榴弹炮', '迫击炮', '火箭炮', '反坦克炮', '防空火炮', '舰炮'][CAST((p_partkey // 50) % 8 AS INT) - 1] AS cat FROM s WHERE (p_partkey // 50) % 8 BETWEEN 2 AND 7), "
    "u AS (SELECT 'DEVELOPED_IN' AS relation, split_part(land, '/', 1) AS target, name FROM c UNION ALL SELECT 'EQUIPPED_BY', unnest(['德国', '意大利']), name FROM c WHERE contains(land, '/') UNION ALL SELECT 'IS_TYPE_OF', cat, name FROM c) "
    "SELECT relation, target, count(*) AS n, min(name) AS first FROM u GROUP BY relation, target",
    "ffill_outline": "WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), s AS (SELECT conv_id, turn * 4 + length(role) % 4 AS seq, turn, role FROM c), "
    "f AS (SELECT conv_id, seq, last_value(CASE WHEN turn % 3 = 0 AND role IN ('system', 'assistant') THEN role || '@' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS category FROM s) SELECT conv_id, category, count(*) AS n, min(seq) AS first FROM f GROUP BY conv_id, category",
    "range_assign": "SELECT 's' || (doc_id // 37) AS name, CAST(min(doc_id) AS INT) AS first, CAST(max(doc_id) AS INT) AS last, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY doc_id // 37",
    "page_concat": "SELECT 's' || (doc_id // 37) AS name, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS md5, length(string_agg(text, chr(10) ORDER BY doc_id)) AS chars FROM documents GROUP BY doc_id // 37",
    "section_cut": r"WITH a AS (SELECT doc_id, substr(text, strpos(text, 'the')) AS s FROM documents WHERE strpos(text, 'the') > 0), b AS (SELECT doc_id, s, substr(s, 11) AS r FROM a), "
    r"c AS (SELECT doc_id, substr(s, 1, least(length(s), coalesce(nullif(strpos(r, 'was'), 0) + 9, length(s)), coalesce(nullif(strpos(r, 'with'), 0) + 9, length(s)), coalesce(nullif(strpos(r, chr(10)), 0) + 9, length(s)))) AS x FROM b) "
    r"SELECT doc_id, length(x) AS chars, md5(x) AS md5, length(regexp_replace(regexp_replace(x, '[^\n]*\S[^\n]*', 'L', 'g'), '[^L]', '', 'g')) AS n_lines FROM c",
    "derivative_valid": "WITH l AS (SELECT DISTINCT x FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)) SELECT x, "
    + _OK.format("换装|安装|整合|由|最初称|炮塔|瞄准具|衍生型|火炮") + " AS in_clean, " + _OK.format("换装|安装|整合|由|最初称|炮塔|瞄准具|火炮|系统衍生型") + " AND NOT (contains(x, ' ') AND length(x) > 16) AS in_view, "
    + "regexp_matches(x, '[A-Za-z0-9]') AND NOT regexp_full_match(x, '[0-9]{1,4}') AND length(x) <= 40 AND NOT (" + _CJK + " > length(x) * 0.5 AND length(x) > 10) AS row, x <> '' AND (contains(x, '底盘') OR contains(x, '卡车') OR x NOT IN ('谢尔曼坦克', '坦克', '步兵战车', '装甲车')) AS chassis FROM l",
    "clean_edges": graph("SELECT seq, source, relation, target, method FROM (SELECT raw.*, row_number() OVER (PARTITION BY raw.source, raw.relation, raw.target ORDER BY seq) AS k FROM raw LEFT JOIN home USING (source) WHERE method = 'base' OR (relation = 'EQUIPPED_BY' AND (h IS NULL OR h <> target))) WHERE k = 1", "home AS (SELECT source, arg_max(target, seq) AS h FROM raw WHERE relation = 'DEVELOPED_IN' GROUP BY source)"),
    "clean_entities": graph("SELECT DISTINCT target_type AS label, target AS name FROM raw WHERE method = 'rule'"),
    "edge_merge_anti": graph("SELECT seq, source, relation, target, method FROM raw WHERE relation <> 'SUPPLIED_BY' AND seq % 2 = 0 UNION ALL SELECT seq, source, relation, target, 'llm' FROM raw r WHERE relation <> 'SUPPLIED_BY' AND seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM raw q WHERE q.relation <> 'SUPPLIED_BY' AND q.seq % 2 = 0 AND q.source = r.source AND q.relation = r.relation AND q.target = r.target)"),
    "prop_edges": "SELECT p_partkey, '口径=' || p_size AS property FROM part UNION ALL SELECT p_partkey, '重量=' || p_brand FROM part WHERE p_size > 9 UNION ALL SELECT p_partkey, 'colour=' || p_name FROM part",
    "store_nodes": graph("SELECT label, name, arg_max(caliber, seq) AS caliber, arg_max(model, seq) AS model, arg_max(page, seq) AS page FROM ent GROUP BY label, name"),
    "store_edges": graph("SELECT DISTINCT source_type, source, relation, target_type, target FROM raw WHERE EXISTS (SELECT 1 FROM ent WHERE label = source_type AND name = source) AND EXISTS (SELECT 1 FROM ent WHERE label = target_type AND name = target)"),
    "store_import": graph("SELECT count(*) AS success, CAST(0 AS BIGINT) AS failed, count(*) FILTER (NOT (EXISTS (SELECT 1 FROM ent WHERE label = source_type AND name = source) AND EXISTS (SELECT 1 FROM ent WHERE label = target_type AND name = target))) AS unmatched FROM raw"),
    "store_counts": graph("SELECT 'node' AS kind, label AS name, count(*) AS n FROM ent GROUP BY ROLLUP (label) UNION ALL SELECT 'edge', relation, count(*) FROM raw GROUP BY ROLLUP (relation)"),
    "prf_entities": graph(_PRF.format(by="") + " FROM (SELECT (SELECT count(*) FROM (SELECT * FROM ge INTERSECT SELECT * FROM me)) AS tp, (SELECT count(*) FROM ge) AS g, (SELECT count(*) FROM me) AS m)", _SETS),
    "prf_relations": graph(_PRF.format(by="") + " FROM (SELECT (SELECT count(*) FROM (SELECT * FROM gt INTERSECT SELECT * FROM mt)) AS tp, (SELECT count(*) FROM gt) AS g, (SELECT count(*) FROM mt) AS m)", _SETS),
    "prf_by_type": graph(_PRF.format(by="relation,") + " FROM (SELECT relation, count(*) FILTER (i = 2) AS tp, count(*) FILTER (gg = 1) AS g, count(*) FILTER (mm = 1) AS m FROM (SELECT source, relation, target, count(*) AS i, max(a) AS gg, max(b) AS mm FROM (SELECT *, 1 AS a, 0 AS b FROM gt UNION ALL SELECT *, 0, 1 FROM mt) GROUP BY source, relation, target) GROUP BY relation)", _SETS),
    "scale_check": graph("SELECT 200 AS entity_requirement, 400 AS relation_requirement, (SELECT count(*) FROM ge) >= 200 AS entity_passed, (SELECT count(*) FROM gt) >= 400 AS relation_passed", _SETS),
    "set_intersect": graph("SELECT * FROM gt INTERSECT SELECT * FROM mt", _SETS),
    "set_except": graph("SELECT * FROM mt EXCEPT SELECT * FROM gt", _SETS),
    "param_profile": graph("SELECT name, ord, key, value, display_value, score, max_value FROM prof", _PROFILE),
    "radar": graph("SELECT name, string_agg(CASE ord WHEN 0 THEN '口径' WHEN 1 THEN '射程' ELSE '重量' END, ',' ORDER BY ord) || ',口径' AS metrics, count(*) + 1 AS n, arg_min(score, ord) AS last FROM prof GROUP BY name", _PROFILE),
    "node_brief": graph("SELECT name, ord, attribute, coalesce(value, '未知') AS value FROM (SELECT name, 0 AS ord, '类别' AS attribute, nullif(category, '') AS value FROM n WHERE label = 'Artillery' UNION ALL SELECT name, 1, '口径', nullif(caliber, '') FROM n WHERE label = 'Artillery' UNION ALL SELECT name, 2, '型号', nullif(model, '') FROM n WHERE label = 'Artillery' UNION ALL SELECT name, 3, '页码', CAST(page AS VARCHAR) FROM n WHERE label = 'Artillery' UNION ALL SELECT name, 4, '射程', nullif(range, '') || ' 米' FROM n WHERE label = 'Artillery' UNION ALL SELECT name, 5, '重量', nullif(weight, '') || ' 千克' FROM n WHERE label = 'Artillery')"),
    "retrieve_score": graph("SELECT name, CAST(score AS BIGINT) AS score FROM sc WHERE score > 0", _SCORES),
    "retrieve_top": graph("SELECT name, score FROM top", _SCORES),
    "retrieve_context": graph("SELECT name, score, '【火炮】' || name || chr(10) || '基础属性：' || facts || chr(10) || '图谱关系：' || rels || chr(10) || '原书OCR摘录：' || body AS context FROM ctx", _SCORES),
    "retrieve_relevance": graph("SELECT CAST((SELECT sum(score) FROM top) + 2 * (SELECT count(*) FROM men) AS BIGINT) AS score, (SELECT sum(score) FROM top) + 2 * (SELECT count(*) FROM men) >= 3 AS is_relevant", _SCORES),
    "retrieve_matched": graph("SELECT label, name FROM men", _SCORES),
    "cards": graph("SELECT 1 AS id, CAST(row_number() OVER (ORDER BY name) - 1 AS INT) AS card, name AS title, replace(facts, '；', ',') AS facts, replace(rels, '；', ',') AS relations FROM ctx", _SCORES),
    "qa_star": graph("SELECT source AS name FROM e WHERE relation = 'DEVELOPED_IN' AND target = 'NATION_15' INTERSECT SELECT source FROM e WHERE relation = 'DESIGNED_BY' AND target = 'Brand#7'"),
    "qa_argmax": graph("SELECT name, CAST(replace(caliber, '毫米', '') AS DOUBLE) AS value FROM n JOIN e ON source = name WHERE relation = 'DESIGNED_BY' AND target = 'Brand#7' AND label = 'Artillery' ORDER BY value DESC, name LIMIT 1"),
    "qa_list": graph("SELECT DISTINCT source AS name FROM e WHERE relation = 'DEVELOPED_IN' AND target = 'NATION_15' ORDER BY name LIMIT 15"),
    "layout_positions": graph("SELECT name, label, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM pos", _GLOBAL),
    "layout_around": graph("SELECT name, label, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM pos UNION ALL SELECT name, label, 0.0, 0.0 FROM n WHERE name = 'NATION_3'", _AROUND),
    "edge_midpoints": graph("SELECT e.source, e.relation, e.target, round(a.x, 6) + 0.0 AS x0, round(a.y, 6) + 0.0 AS y0, round(b.x, 6) + 0.0 AS x1, round(b.y, 6) + 0.0 AS y1, round((a.x + b.x) / 2, 6) + 0.0 AS mid_x, round((a.y + b.y) / 2, 6) + 0.0 AS mid_y FROM e JOIN pos a ON a.name = e.source JOIN pos b ON b.name = e.target", _GLOBAL),
    "stats_bars": graph("SELECT target, n, CAST(row_number() OVER (ORDER BY n, m DESC) - 1 AS INT) AS ord FROM (SELECT target, count(*) AS n, min({'s': source, 'q': seq}) AS m FROM e WHERE relation = 'EQUIPPED_BY' GROUP BY target ORDER BY n DESC, m LIMIT 12)"),
    "node_panel": graph(
        "SELECT 'attributes' AS section, CAST(ord AS INT) AS ord, key, coalesce(value, '未知') AS value FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['类别', '口径', '型号', '页码', '射程', '重量']) AS key, unnest([category, caliber, model, CAST(page AS VARCHAR), range || ' 米', weight || ' 千克']) AS value FROM n WHERE name = 'part#7') "
        "UNION ALL SELECT 'parameters', ord, CASE ord WHEN 0 THEN '口径' WHEN 1 THEN '射程' ELSE '重量' END, CAST(display_value AS VARCHAR) || CASE ord WHEN 0 THEN ' mm' WHEN 1 THEN ' m' ELSE ' kg' END FROM prof WHERE name = 'part#7' "
        "UNION ALL SELECT 'relations', CAST(k - 1 AS INT), relation_label, target FROM (SELECT relation_label, target, row_number() OVER (PARTITION BY relation_label ORDER BY target) AS k FROM (SELECT DISTINCT relation_label, target FROM e WHERE source = 'part#7')) WHERE k <= 12", _PROFILE),
    "node_panel_land": graph(
        "SELECT 'counts' AS section, 0 AS ord, 'in' AS key, CAST(count(*) AS VARCHAR) AS value FROM e WHERE target = 'NATION_3' UNION ALL SELECT 'counts', 1, 'out', CAST(count(*) AS VARCHAR) FROM e WHERE source = 'NATION_3' "
        "UNION ALL SELECT 'related', CAST(k - 1 AS INT), '', source FROM (SELECT source, row_number() OVER (ORDER BY seq) AS k FROM e WHERE target = 'NATION_3' AND source_type = 'Artillery') WHERE k <= 18 "
        "UNION ALL SELECT 'in', CAST(k - 1 AS INT), relation_label, source FROM (SELECT relation_label, source, row_number() OVER (ORDER BY seq) AS k FROM e WHERE target = 'NATION_3') WHERE k <= 8"),
    "answer_local": graph("SELECT 'part#7 的局部知识如下。出边: ' || string_agg(relation_label || ' -> ' || target, '；' ORDER BY seq) AS answer FROM (SELECT * FROM e WHERE source = 'part#7' ORDER BY seq LIMIT 6)"),
    "bound_columns": "WITH p AS (SELECT p_partkey AS k, 'part#' || p_partkey AS name, p_partkey % 50 AS page FROM part), l AS (SELECT page, 'part#' || max(k) AS last FROM p WHERE page < 40 GROUP BY page) "
    "SELECT name, length(coalesce(text, '')) AS chars, CASE WHEN k % 3 = 0 THEN name || '.jpg' ELSE '' END AS image_path, CASE WHEN k % 3 = 0 THEN 'area' ELSE '' END AS image_method, CASE WHEN k % 3 = 0 THEN CAST(page AS VARCHAR) END AS old, last, (SELECT count(*) FROM p WHERE k % 3 = 0) AS n_parameters FROM p LEFT JOIN l USING (page) LEFT JOIN documents ON doc_id = k",
    "edge_methods": graph("SELECT method, count(*) AS n FROM raw GROUP BY method"),
    "store_countries": "SELECT s_name AS name FROM supplier UNION SELECT n_name FROM nation",
    "bbox_score": f"WITH {_BOX} SELECT seq, score, round(CASE WHEN NOT (bw < 132 OR bh < 64 OR bw * bh / 480000 < 0.03 OR y0 > 624) THEN 100 * (bw * bh / 480000) + CASE WHEN bw / greatest(bh, 1) BETWEEN 1.1 AND 3.8 THEN 18 ELSE 0 END + CASE WHEN y0 < 464 THEN 20 ELSE 0 END + CASE WHEN p_size > 28 THEN 18 WHEN p_size > 18 THEN 8 ELSE 0 END + CASE WHEN bw > 270 THEN 8 ELSE 0 END + CASE WHEN bh > 96 THEN 8 ELSE 0 END - CASE WHEN x0 < 24 OR x0 + bw > 576 THEN 6 ELSE 0 END - CASE WHEN y0 < 40 THEN 6 ELSE 0 END END, 4) AS area FROM sb",
    "best_candidate": f"WITH {_BOX} SELECT grp, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, seq) AS k FROM sb WHERE score >= 0) WHERE k = 1",
    "dense_band": "WITH v AS (SELECT event_id // 100 AS grp, event_id % 100 AS idx, value, max(value) OVER (PARTITION BY event_id // 100) AS m FROM events), d AS (SELECT *, idx - row_number() OVER (PARTITION BY grp ORDER BY idx) AS r FROM v WHERE m > 0 AND value >= 0.1 * m), g AS (SELECT grp, r, min(idx) AS first, max(idx) AS last FROM d GROUP BY grp, r HAVING max(idx) - min(idx) + 1 >= 3) SELECT grp, first, last FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY last - first DESC, first) AS k FROM g) WHERE k = 1",
    "llm_json_parse": "SELECT p_partkey, p_brand AS source, 'MADE' AS relation, p_name AS target FROM part WHERE p_partkey % 4 <> 0",
    "stream_edges": f"SELECT DISTINCT 'doc#' || doc_id AS source, 'MENTIONS' AS relation, name AS target FROM documents, {_WORDS.format('')} WHERE contains(text, word)",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    **rich.ORACLES,
    **bulk.ORACLES,
}
