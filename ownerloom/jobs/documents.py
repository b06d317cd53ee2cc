"""Queries over merges of JSON, text and Markdown documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownerloom.jobs.demo_data import table
from ownerloom.jobs.texts import _BLOCKS
from ownerloom.operators import cutting, documents, merging

#: Members of three revisions of an event, in SQL that Spark and DuckDB both run; null where a revision has none.
_MEMBERS = {
    "base": ("1", "CASE WHEN e % 3 <> 0 THEN '2' END", "k", "concat('[1,', k, ']')"),
    "ours": ("CASE WHEN e % 5 = 0 THEN '7' ELSE '1' END", "CASE WHEN e % 3 <> 0 THEN CASE WHEN e % 7 <> 0 THEN '2' END WHEN e % 4 = 0 THEN '3' END", "CASE WHEN e % 2 = 0 THEN '-1' ELSE k END", "CASE WHEN e % 11 = 0 THEN '[2]' ELSE concat('[1,', k, ']') END"),
    "theirs": ("CASE WHEN e % 10 = 0 THEN '7' WHEN e % 15 = 0 THEN '8' ELSE '1' END", "CASE WHEN e % 3 <> 0 THEN CASE WHEN e % 14 = 0 THEN '5' WHEN e % 13 <> 0 THEN '2' END WHEN e % 8 = 0 THEN '3' WHEN e % 9 = 0 THEN '4' END", "CASE WHEN e % 6 = 0 THEN '-1' WHEN e % 8 = 0 THEN '-2' ELSE k END", "CASE WHEN e % 22 = 0 THEN '[3]' ELSE concat('[1,', k, ']') END"),
}


def _json_text(role: str) -> str:
    a, b, c, d = _MEMBERS[role]
    return f"""concat('{{"l":', {d}, ',"c":{{"d":', {c}, ',"s":0}},"a":', {a}, coalesce(concat(',"b/":', {b}), ''), '}}')"""


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.get_json_object("props", "$.k").alias("k"))
    rows = events.select("e", F.col("e").alias("doc_id"), *[F.expr(_json_text(r)).alias(r) for r in _MEMBERS])
    return rows.withColumn("theirs", F.when(F.col("e") % 500 == 0, '{"a":1,"a":2}').otherwise(F.col("theirs")))


def merge_json_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.merge_json_three_way(_revisions(spark, sf_dir)).select("doc_id", "path", "kind", "source", "category", F.md5("value").alias("digest"))


_EVENTS = "ev AS (SELECT event_id AS e, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)"
_SIDES = ", ".join(f"{x} AS {n}{r[0]}" for r, m in _MEMBERS.items() for n, x in zip(("a_", "b_", "c", "l"), m, strict=True))
_THREE_SQL = f"""WITH {_EVENTS}, v AS (SELECT e, {_SIDES} FROM ev WHERE e % 500 <> 0),
m AS (SELECT e, 1 AS n, '/a' AS path, a_b AS b, a_o AS o, a_t AS t FROM v UNION ALL SELECT e, 2, '/b~1', b_b, b_o, b_t FROM v UNION ALL SELECT e, 3, '/c', concat('{{"d":', cb, ',"s":0}}'), concat('{{"d":', co, ',"s":0}}'), concat('{{"d":', ct, ',"s":0}}') FROM v UNION ALL SELECT e, 4, '/l', lb, lo, lt FROM v),
w AS (SELECT e, string_agg(coalesce(b, '-'), ';' ORDER BY n) AS b, string_agg(coalesce(o, '-'), ';' ORDER BY n) AS o, string_agg(coalesce(t, '-'), ';' ORDER BY n) AS t FROM m GROUP BY 1),
q AS (SELECT e, CASE WHEN o = t OR t = b THEN 'ours' WHEN o = b THEN 'theirs' END AS side FROM w),
whole AS (SELECT q.e, side, concat('{{"a":', CASE side WHEN 'ours' THEN a_o ELSE a_t END, coalesce(',"b/":' || CASE side WHEN 'ours' THEN b_o ELSE b_t END, ''), ',"c":{{"d":', CASE side WHEN 'ours' THEN co ELSE ct END, ',"s":0}},"l":', CASE side WHEN 'ours' THEN lo ELSE lt END, '}}') AS value FROM q JOIN v USING (e) WHERE side IS NOT NULL),
s AS (SELECT m.*, CASE WHEN b IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o = t OR t = b THEN 'ours' WHEN o = b THEN 'theirs' WHEN n = 4 THEN 'atomic_array_edit' WHEN n = 3 THEN 'recurse' ELSE 'modify_modify' END
  WHEN o IS NULL AND t IS NULL THEN 'gone' WHEN b IS NULL THEN CASE WHEN t IS NULL THEN 'ours' WHEN o IS NULL THEN 'theirs' WHEN o = t THEN 'ours' ELSE 'ambiguous_owner_change' END
  WHEN o IS NULL THEN CASE WHEN b = t THEN 'gone' ELSE 'ambiguous_owner_change' END WHEN b = o THEN 'delete_requires_owner_edit' ELSE 'ambiguous_owner_change' END AS step FROM m JOIN q USING (e) WHERE side IS NULL),
r AS (SELECT e, path, b, o, t, step FROM s WHERE step NOT IN ('gone', 'recurse', 'atomic_array_edit')
  UNION ALL SELECT e, '/l/0', '1', CASE WHEN k <> '2' THEN '2' END, CASE WHEN k <> '3' THEN '3' END, CASE WHEN k IN ('2', '3') THEN 'delete_modify' ELSE 'modify_modify' END FROM s JOIN ev USING (e) WHERE step = 'atomic_array_edit' UNION ALL SELECT e, '/c/d', cb, co, ct, 'modify_modify' FROM s JOIN v USING (e) WHERE step = 'recurse' UNION ALL SELECT e, '/c/s', '0', '0', '0', 'ours' FROM s WHERE step = 'recurse'),
j AS (SELECT *, concat('{{', concat_ws(',', '"base":"' || b || '"', '"ours":"' || o || '"', '"theirs":"' || t || '"'), '}}') AS three FROM r)
SELECT e AS doc_id, path, CASE WHEN step IN ('ours', 'theirs') THEN 'resolved' ELSE 'conflict' END AS kind, CASE WHEN step IN ('ours', 'theirs') THEN step END AS source, CASE WHEN step NOT IN ('ours', 'theirs') THEN step END AS category, md5(CASE step WHEN 'ours' THEN o WHEN 'theirs' THEN t ELSE three END) AS digest FROM j
UNION ALL SELECT e, '', 'resolved', side, NULL, md5(value) FROM whole UNION ALL SELECT e, '', 'parse_error', NULL, NULL, NULL FROM ev WHERE e % 500 = 0"""


def merge_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome and merged text of each document."""
    return documents.json_texts(documents.merge_json_three_way(_revisions(spark, sf_dir))).select("doc_id", "outcome", F.md5("output").alias("digest"))


_PICK = "CASE WHEN {o} IS NOT DISTINCT FROM {t} OR {t} IS NOT DISTINCT FROM {b} THEN {o} ELSE {t} END"
_PICKED = {n: _PICK.format(b=f"{n}b", o=f"{n}o", t=f"{n}t") for n in ("a_", "b_", "c", "l")}
_CLASH = " OR ".join(f"({n}b IS DISTINCT FROM {n}o AND {n}b IS DISTINCT FROM {n}t AND {n}o IS DISTINCT FROM {n}t)" for n in ("a_", "b_", "c", "l"))
_DOCUMENTS_SQL = f"""WITH {_EVENTS}, v AS (SELECT e, {_SIDES} FROM ev WHERE e % 500 <> 0),
w AS (SELECT *, {" AND ".join(f"{n}o IS NOT DISTINCT FROM {n}t" for n in ("a_", "b_", "c", "l"))} AS same, {" AND ".join(f"{n}o IS NOT DISTINCT FROM {n}b" for n in ("a_", "b_", "c", "l"))} AS left_ours, {" AND ".join(f"{n}t IS NOT DISTINCT FROM {n}b" for n in ("a_", "b_", "c", "l"))} AS left_theirs FROM v),
c AS (SELECT *, NOT (same OR left_ours OR left_theirs) AND ({_CLASH} OR (b_b IS NOT NULL AND b_t IS NULL AND b_o IS NOT NULL)) AS clash FROM w)
SELECT e AS doc_id, CASE WHEN clash THEN 'conflict' ELSE 'clean' END AS outcome, CASE WHEN NOT clash THEN md5(concat('{{"a":', {_PICKED["a_"]}, coalesce(',"b/":' || {_PICKED["b_"]}, ''), ',"c":{{"d":', {_PICKED["c"]}, ',"s":0}},"l":', {_PICKED["l"]}, '}}')) END AS digest FROM c
UNION ALL SELECT e, 'error', NULL FROM ev WHERE e % 500 = 0"""


def merge_mapping_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.merge_mapping_two_way(_revisions(spark, sf_dir), "theirs", "ours").select("doc_id", "path", "kind", "source", "value")


_TWO_SQL = f"""WITH {_EVENTS}, v AS (SELECT e, {_SIDES} FROM ev WHERE e % 500 <> 0)
SELECT e AS doc_id, '/a' AS path, 'resolved' AS kind, 'destination' AS source, a_o AS value FROM v UNION ALL SELECT e, '/l', 'resolved', 'destination', lo FROM v UNION ALL SELECT e, '/c/d', 'resolved', 'destination', co FROM v UNION ALL SELECT e, '/c/s', 'resolved', 'destination', '0' FROM v
UNION ALL SELECT e, '/b~1', 'resolved', CASE WHEN b_o IS NULL THEN 'template' ELSE 'destination' END, coalesce(b_o, b_t) FROM v WHERE b_o IS NOT NULL OR b_t IS NOT NULL UNION ALL SELECT e, '', 'parse_error', NULL, NULL FROM ev WHERE e % 500 = 0"""


#: Elements of three revisions of a conversation's array: which turns each has, their text and place, in SQL that Spark and DuckDB both run.
_ELEMENTS = {
    "b": ("k % 7 <> 5", "x", "k"),
    "o": ("NOT (k % 4 = 2 AND c % 5 = 0) AND (k % 7 <> 5 OR c % 3 = 1)", "CASE WHEN k % 3 = 0 AND c % 2 = 0 THEN concat(x, 'o') ELSE x END", "CASE WHEN c % 9 = 0 THEN -k ELSE k END"),
    "t": ("NOT (k % 5 = 3 AND c % 4 = 0) AND (k % 7 <> 5 OR c % 3 <> 0)", "CASE WHEN k % 4 = 0 AND c % 2 = 0 OR k % 7 = 5 AND c % 2 = 1 THEN concat(x, 't') ELSE x END", "CASE WHEN c % 9 = 0 AND c % 2 = 0 THEN -k WHEN c % 9 = 0 AND k % 2 = 1 THEN k + 1000 ELSE k END"),
}
_ELEMENT = """concat('{"id":', k, ',"t":"', y, '"}')"""


def json_array_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as arrays of objects with an id: what two tips of an array can not both have."""
    out = documents.array_conflicts(_arrays(spark, sf_dir))
    return out.select("doc_id", F.col("base_index").cast("long").alias("base_index"), "category", *[F.md5(s).alias(s) for s in ("b", "o", "t")])


def match_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of base's and ours' arrays of each conversation, by id and then by aliases."""
    arrays = _arrays(spark, sf_dir).withColumnRenamed("doc_id", "case_id")
    out = merging.match_identities(documents.array_nodes(arrays, "b"), documents.array_nodes(arrays, "o"))
    return out.select("case_id", *[F.col(c).cast("long").alias(c) for c in ("template_pos", "destination_pos")])


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and three revisions b, o, t of each conversation as a JSON array; conversations that have all three."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("k"), F.md5("text").alias("x"))
    whole = None
    for side, (keep, text, place) in _ELEMENTS.items():
        rows = turns.where(keep).select("c", F.expr(place).alias("place"), "k", F.expr(text).alias("y")).withColumn("e", F.expr(_ELEMENT))
        texts = rows.groupBy("c").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "e"))), lambda r: r.e), ","), F.lit("]")).alias(side))
        whole = texts if whole is None else whole.join(texts, "c")
    return whole.select(F.col("c").alias("doc_id"), F.lit("/turns").alias("path"), "b", "o", "t")


def _side_sql(side: str) -> str:
    keep, text, place = _ELEMENTS[side]
    return f"{side} AS (SELECT c, k, {_ELEMENT} AS e, row_number() OVER (PARTITION BY c ORDER BY place) - 1 AS i FROM (SELECT c, k, {text} AS y, {place} AS place FROM v WHERE {keep}))"


def _aligned_sql(side: str) -> str:
    """Base elements with those of a side: by id, and what is left by place."""
    return f"""{side}1 AS (SELECT b.c, b.i AS bi, {side}.i AS si, {side}.e FROM b JOIN {side} ON {side}.c = b.c AND {side}.k = b.k),
{side}2 AS (SELECT * FROM {side}1 UNION ALL SELECT b.c, b.i, {side}.i, {side}.e FROM b JOIN {side} ON {side}.c = b.c AND {side}.i = b.i WHERE NOT EXISTS (SELECT 1 FROM {side}1 m WHERE m.c = b.c AND m.bi = b.i) AND NOT EXISTS (SELECT 1 FROM {side}1 m WHERE m.c = b.c AND m.si = b.i)),
{side}3 AS (SELECT * FROM {side} WHERE NOT EXISTS (SELECT 1 FROM {side}2 m WHERE m.c = {side}.c AND m.si = {side}.i))"""


_IDENTITIES_SQL = f"""WITH v AS (SELECT conv_id AS c, turn AS k, md5(text) AS x FROM conversations), {_side_sql("b")}, {_side_sql("o")}, {_side_sql("t")}, {_aligned_sql("o")}
SELECT c AS case_id, bi AS template_pos, si AS destination_pos FROM o2 JOIN (SELECT c FROM b INTERSECT SELECT c FROM o INTERSECT SELECT c FROM t) USING (c)"""
_ARRAYS_SQL = f"""WITH v AS (SELECT conv_id AS c, turn AS k, md5(text) AS x FROM conversations), {_side_sql("b")}, {_side_sql("o")}, {_side_sql("t")}, {_aligned_sql("o")}, {_aligned_sql("t")},
has AS (SELECT c FROM b INTERSECT SELECT c FROM o INTERSECT SELECT c FROM t),
n1 AS (SELECT o3.c, o3.i AS oi, t3.i AS ti, o3.e AS oe, t3.e AS te FROM o3 JOIN t3 ON o3.c = t3.c AND o3.k = t3.k),
n2 AS (SELECT * FROM n1 UNION ALL SELECT o3.c, o3.i, t3.i, o3.e, t3.e FROM o3 JOIN t3 ON o3.c = t3.c AND o3.i = t3.i WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.c = o3.c AND n1.oi = o3.i) AND NOT EXISTS (SELECT 1 FROM n1 WHERE n1.c = t3.c AND n1.ti = t3.i)),
rows AS (SELECT b.c, b.i, b.e AS b, o2.e AS o, t2.e AS t FROM b LEFT JOIN o2 ON o2.c = b.c AND o2.bi = b.i LEFT JOIN t2 ON t2.c = b.c AND t2.bi = b.i),
content AS (SELECT c, i, CASE WHEN (o IS NULL AND t <> b) OR (t IS NULL AND o <> b) THEN 'delete_modify' WHEN o <> b AND t <> b AND o <> t THEN 'modify_modify' END AS category, b, o, t FROM rows),
orders AS (SELECT c, list(bi ORDER BY si) AS l FROM o2 GROUP BY c), others AS (SELECT c, list(bi ORDER BY si) AS l FROM t2 GROUP BY c),
whole AS (SELECT c, (SELECT '[' || string_agg(e, ',' ORDER BY i) || ']' FROM b WHERE b.c = h.c) AS b, (SELECT '[' || string_agg(e, ',' ORDER BY i) || ']' FROM o WHERE o.c = h.c) AS o, (SELECT '[' || string_agg(e, ',' ORDER BY i) || ']' FROM t WHERE t.c = h.c) AS t FROM has h),
found AS (SELECT * FROM content WHERE category IS NOT NULL UNION ALL SELECT c, NULL, 'duplicate_insertion', NULL, oe, te FROM n2 WHERE oe <> te
  UNION ALL SELECT c, NULL, 'order', b, o, t FROM orders p JOIN others q USING (c) JOIN whole USING (c) WHERE p.l <> q.l AND p.l <> list_sort(p.l) AND q.l <> list_sort(q.l))
SELECT c AS doc_id, CAST(i AS BIGINT) AS base_index, category, md5(b) AS b, md5(o) AS o, md5(t) AS t FROM found JOIN has USING (c)"""


def _block_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of every document; the destination has them turned around, some edited and some gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))
    template = cutting.text_blocks(docs).select(F.col("doc_id").alias("case_id"), "index", "normalized")
    edited = F.when(F.col("index") % 3 == 1, F.concat(F.lit("New "), "normalized")).otherwise(F.col("normalized"))
    kept = template.where("index % 5 <> 4").withColumn("normalized", edited)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("index"))) - 1
    return template, kept.select("case_id", place.alias("index"), "normalized")


def match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matching of template and destination blocks, exact and refined."""
    out = documents.match_text(*_block_sides(spark, sf_dir))
    return out.select("case_id", F.col("template_index").cast("long").alias("template_index"), F.col("destination_index").cast("long").alias("destination_index"), "phase", F.round("score", 9).alias("score"))


def match_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ownerloom.operators import merging

    out = merging.match_text_exact(*_block_sides(spark, sf_dir))
    return out.select("case_id", F.col("template_index").cast("long").alias("template_index"), F.col("destination_index").cast("long").alias("destination_index"))


_EXACT_SQL = f"""WITH p AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM documents), b AS (SELECT doc_id, {_BLOCKS} AS bs FROM p),
t AS (SELECT doc_id AS case_id, unnest(range(len(bs))) AS index, unnest(bs) AS x FROM b), d AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY index DESC) - 1 AS index, CASE WHEN index % 3 = 1 THEN 'New ' || x ELSE x END AS x FROM t WHERE index % 5 <> 4),
tn AS (SELECT *, row_number() OVER (PARTITION BY case_id, x ORDER BY index) AS n FROM t), dn AS (SELECT *, row_number() OVER (PARTITION BY case_id, x ORDER BY index) AS n FROM d)
SELECT coalesce(tn.case_id, dn.case_id) AS case_id, tn.index AS template_index, dn.index AS destination_index FROM tn FULL JOIN dn ON tn.case_id = dn.case_id AND tn.x = dn.x AND tn.n = dn.n"""


def merge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.merge_text(*_block_sides(spark, sf_dir)).select("case_id", F.md5("output").alias("digest"), "n_blocks")


def merge_markdown_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sections; tips edit, drop, add and (every ninth) turn them around."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("text"))
    k, c = F.col("turn"), F.col("conv_id")
    role = lambda name, text, keep, place: turns.where(keep).select(c.alias("case_id"), F.lit(name).alias("role"), place.alias("place"), F.concat(F.lit("## "), k.cast("string")).alias("head"), text.alias("body"))
    edit = lambda test, mark: F.when(test, F.concat("text", F.lit(mark))).otherwise(F.col("text"))
    rows = role("base", F.col("text"), "turn % 7 <> 5", k)
    rows = rows.unionByName(role("ours", edit((k % 3 == 0) & (c % 2 == 0), "o"), "NOT (turn % 4 = 2 AND conv_id % 5 = 0) AND (turn % 7 <> 5 OR conv_id % 3 = 1)", F.when(c % 9 == 0, -k).otherwise(k)))
    rows = rows.unionByName(role("theirs", edit((k % 4 == 0) & (c % 2 == 0) | (k % 6 == 1) & (c % 10 == 1), "t"), "turn % 7 <> 5 OR conv_id % 3 = 2", k))
    lines = rows.select("case_id", "role", "place", F.posexplode(F.array("head", "body")).alias("p", "text"))
    line = F.row_number().over(Window.partitionBy("case_id", "role").orderBy("place", "p"))
    out = documents.merge_markdown_three_way(lines.select("case_id", "role", line.alias("line"), "text"))
    return out.select("case_id", "outcome", "why", F.md5("output").alias("digest"))


_MARKDOWN_SQL = """WITH v AS (SELECT conv_id AS c, turn AS k, md5(text) AS x FROM conversations),
s AS (SELECT c, k, CASE WHEN k % 7 <> 5 THEN x END AS b, CASE WHEN NOT (k % 4 = 2 AND c % 5 = 0) AND (k % 7 <> 5 OR c % 3 = 1) THEN CASE WHEN k % 3 = 0 AND c % 2 = 0 THEN x || 'o' ELSE x END END AS o,
  CASE WHEN k % 7 <> 5 OR c % 3 = 2 THEN CASE WHEN (k % 4 = 0 AND c % 2 = 0) OR (k % 6 = 1 AND c % 10 = 1) THEN x || 't' ELSE x END END AS t FROM v),
q AS (SELECT c, string_agg(k || ':' || b, ',' ORDER BY k) FILTER (b IS NOT NULL) AS bs, string_agg(k || ':' || o, ',' ORDER BY CASE WHEN c % 9 = 0 THEN -k ELSE k END) FILTER (o IS NOT NULL) AS os, string_agg(k || ':' || t, ',' ORDER BY k) FILTER (t IS NOT NULL) AS ts,
  count(*) FILTER (o IS NOT NULL AND t IS NOT NULL) AS common, count(*) FILTER (b IS NOT NULL) AS nb, count(*) FILTER (o IS NOT NULL) AS no, count(*) FILTER (t IS NOT NULL) AS nt,
  count(*) FILTER (b IS DISTINCT FROM o AND b IS DISTINCT FROM t AND o IS DISTINCT FROM t) AS clashes,
  string_agg('## ' || k || chr(10) || o, chr(10) ORDER BY CASE WHEN c % 9 = 0 THEN -k ELSE k END) FILTER (o IS NOT NULL) AS ot, string_agg('## ' || k || chr(10) || t, chr(10) ORDER BY k) FILTER (t IS NOT NULL) AS tt,
  string_agg('## ' || k || chr(10) || CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o ELSE t END, chr(10) ORDER BY k) FILTER (CASE WHEN o IS NOT DISTINCT FROM t OR t IS NOT DISTINCT FROM b THEN o ELSE t END IS NOT NULL) AS merged FROM s GROUP BY 1),
w AS (SELECT *, CASE WHEN nb = 0 OR no = 0 OR nt = 0 THEN 'missing' WHEN os = ts OR bs = ts THEN 'whole_source_ours' WHEN bs = os THEN 'whole_source_theirs' WHEN c % 9 = 0 AND common > 1 THEN 'order' WHEN clashes > 0 THEN 'section' ELSE 'merged' END AS why FROM q)
SELECT c AS case_id, CASE WHEN why IN ('order', 'section') THEN 'conflict' ELSE 'clean' END AS outcome, why, CASE why WHEN 'whole_source_ours' THEN md5(ot) WHEN 'whole_source_theirs' THEN md5(tt) WHEN 'merged' THEN md5(merged) END AS digest FROM w"""


QUERIES = {f.__name__: f for f in (merge_json_three_way, merge_json_documents, json_array_conflicts, match_identities, merge_mapping_two_way, match_text, match_text_exact, merge_text, merge_markdown_three_way)}
SQL = {"merge_json_three_way": _THREE_SQL, "merge_json_documents": _DOCUMENTS_SQL, "json_array_conflicts": _ARRAYS_SQL, "match_identities": _IDENTITIES_SQL, "merge_mapping_two_way": _TWO_SQL, "match_text_exact": _EXACT_SQL, "merge_markdown_three_way": _MARKDOWN_SQL}
