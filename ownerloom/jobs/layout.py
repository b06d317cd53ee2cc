"""Queries over merges that keep the bytes between owners, and their SQL.

A customer's orders are the owners of three sources, each on a line with an indent and a remark, under a comment or a blank line.
The SQL looks at lines and what touches them, the output's lines included; the operators cut gaps at their line ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.jobs.demo_data import table
from ownerloom.operators import layout
from ownerloom.sources.scratch import written

#: Customers whose revisions are the same as base.
_OURS, _THEIRS = "c % 7 <> 5", "c % 7 <> 3"
_MEMBERS = {
    "base": "k % 13 <> 0",
    "ours": f"(k % 13 <> 0 AND NOT ({_OURS} AND ((c % 5 = 2 AND k % 12 IN (0, 3)) OR (c % 10 = 9 AND k % 12 = 7)))) OR (k % 13 = 0 AND {_OURS} AND c % 5 = 1 AND k % 2 = 0)",
    "theirs": f"(k % 13 <> 0 AND NOT ({_THEIRS} AND c % 5 = 4 AND k % 12 IN (0, 3))) OR (k % 13 = 0 AND {_THEIRS} AND c % 5 IN (1, 3) AND k % 2 = 1)",
}
_EDITS = {
    "base": "''",
    "ours": f"CASE WHEN {_OURS} AND k % 4 = 1 THEN CASE WHEN c % 12 = 4 THEN concat('A', chr(10)) ELSE 'A' END ELSE '' END",
    "theirs": f"CASE WHEN {_THEIRS} AND c % 11 = 0 AND k % 4 = 1 THEN 'C' WHEN {_THEIRS} AND k % 4 = 2 THEN 'B' ELSE '' END",
}
_PLACES = {"base": "k", "ours": f"CASE WHEN {_OURS} AND c % 34 = 0 THEN -k ELSE k END", "theirs": f"CASE WHEN {_THEIRS} AND c % 17 = 0 THEN -k ELSE k END"}
_GAPS = {r: "CASE k % 3 WHEN 1 THEN concat('# é ', k, chr(10)) WHEN 2 THEN chr(10) ELSE '' END" for r in _MEMBERS}
_GAPS["ours"] = f"CASE WHEN {_OURS} AND c % 23 = 0 AND k % 5 = 0 THEN concat('## ', k, chr(10)) ELSE {_GAPS['base']} END"

#: Owners of the three sources and a row without owner for each suffix, in SQL that Spark and DuckDB both run over a view `orders`.
PIECES_SQL = " UNION ALL ".join(
    f"""SELECT '{r}' AS role, c AS case_id, k AS owner_id, {_PLACES[r]} AS place, {_GAPS[r]} AS gap, CASE WHEN k % 2 = 0 THEN '  ' ELSE '' END AS indent,
  concat('t', k, {_EDITS[r]}) AS text, CASE WHEN c % 31 = 0 AND k % 9 = 0 THEN '; ' WHEN k % 5 = 1 THEN concat(' # x', chr(10)) ELSE chr(10) END AS rest
FROM (SELECT o_custkey AS c, o_orderkey AS k FROM orders) o WHERE {_MEMBERS[r]}
UNION ALL SELECT DISTINCT '{r}', c, CAST(NULL AS BIGINT), CAST(1000000000000 AS BIGINT), CASE WHEN c % 3 = 0 THEN concat('# end', chr(10)) ELSE '' END, '', '', '' FROM (SELECT o_custkey AS c FROM orders) o"""
    for r in _MEMBERS
)
_SHIFT_START = "CASE WHEN role = 'base' AND case_id % 41 = 0 AND owner_id % 2 = 1 THEN 40 ELSE 0 END"
_SHIFT_END = "CASE WHEN role = 'theirs' AND case_id % 37 = 0 AND owner_id % 6 = 0 THEN 1000000 ELSE 0 END"

_PLACED = """n1 AS (SELECT role, case_id, owner_id, text, rest, indent, row_number() OVER w - 1 AS pos, concat(coalesce(lag(rest) OVER w, ''), gap, indent) AS gap FROM pieces0 WINDOW w AS (PARTITION BY role, case_id ORDER BY place)),
n2 AS (SELECT *, sum({size}(gap) + {size}(text)) OVER (PARTITION BY role, case_id ORDER BY pos) - {size}(text) AS s FROM n1)"""


def _revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, owners) of all customers with orders."""
    rows = spark.sql(PIECES_SQL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    rows = spark.sql("WITH " + _PLACED.format(size="octet_length").replace("FROM pieces0", "FROM {rows}") + " SELECT * FROM n2", rows=rows)
    # Text and owners of a source come from one shuffle and lie in one table.
    rows = rows.withColumns({"start_byte": F.expr(f"s - {_SHIFT_START}"), "end_byte": F.expr(f"s + octet_length(text) + {_SHIFT_END}")})
    parts = rows.groupBy("case_id", "role").agg(F.sort_array(F.collect_list(F.struct("pos", "gap", "text", "owner_id", "start_byte", "end_byte"))).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(p.gap, p.text)), "")
    owned = F.transform(F.filter("ps", lambda p: p.owner_id.isNotNull()), lambda p: F.struct(p.owner_id.alias("owner_id"), p.start_byte.alias("start_byte"), p.end_byte.alias("end_byte")))
    both = written(parts.select("case_id", "role", text.alias("text"), owned.alias("owners")), "revisions")
    return both.select("case_id", "role", "text"), both.select("case_id", "role", F.inline("owners"))


def merge_with_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every case."""
    return layout.merge_with_layout(*_revisions(spark, sf_dir))[0]


def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every merged source."""
    rows = layout.merge_with_layout(*_revisions(spark, sf_dir))[1]
    return rows.select("case_id", F.col("ordinal").cast("long").alias("ordinal"), "revision", "owner_id", "src_start", "src_end", "out_start", "out_end", "sha256")


def render_with_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every merged source."""
    return layout.render_segments(*layout.merge_with_layout(*_revisions(spark, sf_dir)))


def verify_merged_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of segments says of every merged source, after faults were put into some: by the case's number a source that lost its
    last byte, a digest of other bytes, a segment that is gone, and an output with a byte more."""
    sources, owners = _revisions(spark, sf_dir)
    verdicts, segments = layout.merge_with_layout(sources, owners)
    segments = written(segments, "segments")
    outputs = layout.render_segments(verdicts, segments)
    fault = F.col("case_id") % 5
    bad = segments.where((fault != 3) | (F.col("ordinal") != 0)).withColumn("sha256", F.when((fault == 2) & (F.col("ordinal") == 1), F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    moved = bad.withColumn("src_end", F.when((fault == 1) & (F.col("ordinal") == 0), F.col("src_end") - 1).otherwise(F.col("src_end")))
    outputs = outputs.withColumn("output", F.when(fault == 4, F.concat("output", F.lit("!"))).otherwise(F.col("output")))
    return layout.verify_segments(sources, outputs, moved)


_SQL = f"""WITH pieces0 AS ({PIECES_SQL}), {_PLACED.format(size="strlen")},
p AS (SELECT *, s + strlen(text) AS e FROM n2),
docs AS (SELECT role, case_id, string_agg(gap || text, '' ORDER BY pos) AS doc FROM p GROUP BY ALL),
told AS (SELECT role, case_id, owner_id, s - {_SHIFT_START} AS s, e + {_SHIFT_END} AS e FROM p WHERE owner_id IS NOT NULL),
judged AS (SELECT t.*, strlen(doc) AS size, max(e) OVER (PARTITION BY role, case_id ORDER BY s, e, owner_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM told t JOIN docs USING (role, case_id)),
faults AS (SELECT case_id, arg_min(CASE WHEN s < 0 OR s >= e OR e > size THEN 'owner_range' ELSE 'owner_overlap' END, (CASE role WHEN 'base' THEN 0 WHEN 'ours' THEN 1 ELSE 2 END, s, e)) AS fault FROM judged WHERE s < 0 OR s >= e OR e > size OR s < above GROUP BY 1),
whole AS (SELECT case_id, CASE WHEN o = t OR b = t THEN 'ours' WHEN b = o THEN 'theirs' END AS whole FROM (SELECT case_id, max(doc) FILTER (role = 'base') AS b, max(doc) FILTER (role = 'ours') AS o, max(doc) FILTER (role = 'theirs') AS t FROM docs GROUP BY 1)),
r AS (SELECT case_id, owner_id, max(text) FILTER (role = 'base') AS b, max(text) FILTER (role = 'ours') AS o, max(text) FILTER (role = 'theirs') AS t,
  max(pos) FILTER (role = 'base') AS bp, max(pos) FILTER (role = 'ours') AS op, max(pos) FILTER (role = 'theirs') AS tp FROM p WHERE owner_id IS NOT NULL GROUP BY ALL),
c AS (SELECT *, b IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL AS firm,
  CASE WHEN o IS NOT DISTINCT FROM t THEN CASE WHEN o IS NULL THEN 'none' ELSE 'ours' END WHEN b IS NOT DISTINCT FROM t THEN CASE WHEN o IS NULL THEN 'none' ELSE 'ours' END
       WHEN b IS NOT DISTINCT FROM o THEN CASE WHEN t IS NULL THEN 'none' ELSE 'theirs' END ELSE 'conflict' END AS pick FROM r),
lists AS (SELECT case_id, bool_or(pick = 'conflict') AS clash, list(owner_id ORDER BY owner_id) FILTER (pick IN ('ours', 'theirs')) AS kept, list(owner_id ORDER BY owner_id) FILTER (o IS NOT NULL) AS o_set, list(owner_id ORDER BY owner_id) FILTER (t IS NOT NULL) AS t_set,
  list(owner_id ORDER BY bp) FILTER (b IS NOT NULL) AS b_list, list(owner_id ORDER BY op) FILTER (o IS NOT NULL) AS o_list, list(owner_id ORDER BY tp) FILTER (t IS NOT NULL) AS t_list,
  list(owner_id ORDER BY bp) FILTER (firm) AS b_firm, list(owner_id ORDER BY op) FILTER (firm) AS o_firm, list(owner_id ORDER BY tp) FILTER (firm) AS t_firm FROM c GROUP BY 1),
plan AS (SELECT *, (b_list IS DISTINCT FROM o_list OR b_list IS DISTINCT FROM t_list) AS changed, CASE WHEN kept IS NOT DISTINCT FROM o_set THEN 'ours' WHEN kept IS NOT DISTINCT FROM t_set THEN 'theirs' WHEN len(list_filter(coalesce(o_set, []), lambda x: NOT list_contains(coalesce(kept, []), x))) = 0 THEN 'ours' END AS baseline,
  kept IS DISTINCT FROM o_set AND kept IS DISTINCT FROM t_set AS extended FROM lists),
body AS (SELECT p.case_id, 0 AS part, p.pos, p.gap, p.owner_id, CASE WHEN p.owner_id IS NULL THEN '' ELSE q.text END AS text, plan.baseline AS gap_rev, p.s AS gap_end, c.pick AS rev, q.s AS src_s, q.e AS src_e, '' AS indent, '' AS rest
    FROM p JOIN plan ON plan.case_id = p.case_id AND plan.baseline = p.role LEFT JOIN c ON c.case_id = p.case_id AND c.owner_id = p.owner_id LEFT JOIN p q ON q.case_id = p.case_id AND q.owner_id = p.owner_id AND q.role = c.pick WHERE NOT clash
  UNION ALL SELECT p.case_id, 1, p.pos, '', p.owner_id, p.text, plan.baseline, 0, 'theirs', p.s, p.e, p.indent, p.rest FROM p JOIN plan ON plan.case_id = p.case_id AND plan.extended AND plan.baseline = 'ours' JOIN c ON c.case_id = p.case_id AND c.owner_id = p.owner_id WHERE p.role = 'theirs' AND c.pick = 'theirs' AND c.o IS NULL AND NOT clash),
made AS (SELECT *, sum(strlen(gap || indent || text || rest)) OVER (PARTITION BY case_id ORDER BY part, pos) - strlen(text) - strlen(rest) AS s FROM body),
all_docs AS (SELECT role, case_id, doc FROM docs UNION ALL SELECT 'out', case_id, string_agg(gap || indent || text || rest, '' ORDER BY part, pos) FROM made GROUP BY case_id),
spans AS (SELECT role, case_id, owner_id, s, e FROM p WHERE owner_id IS NOT NULL UNION ALL SELECT 'out', case_id, owner_id, s, s + strlen(text) FROM made WHERE owner_id IS NOT NULL),
split AS (SELECT role, case_id, string_split(doc, chr(10)) AS parts FROM all_docs),
l0 AS (SELECT role, case_id, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS t FROM split),
l1 AS (SELECT role, case_id, line, t || CASE WHEN line < n THEN chr(10) ELSE '' END AS t FROM l0 WHERE line < n OR t <> ''),
lns AS (SELECT *, sum(strlen(t)) OVER (PARTITION BY role, case_id ORDER BY line) AS e, sum(strlen(t)) OVER (PARTITION BY role, case_id ORDER BY line) - strlen(t) AS s FROM l1),
touched AS (SELECT l.role, l.case_id, l.line, count(*) AS n FROM lns l JOIN spans x ON x.role = l.role AND x.case_id = l.case_id AND x.s < l.e AND x.e > l.s GROUP BY ALL),
shared AS (SELECT DISTINCT role, case_id FROM touched WHERE n > 1),
firm_spans AS (SELECT spans.* FROM spans JOIN c USING (case_id, owner_id) WHERE firm),
ends AS (SELECT role, case_id, max(spans.e) AS last_owner, max(spans.e) FILTER (c.firm) AS last_firm, count(*) FILTER (c.firm) AS n_firm FROM spans JOIN c USING (case_id, owner_id) GROUP BY ALL),
free AS (SELECT l.role, l.case_id, l.line, l.s, any_value(l.t) AS t, count(f.owner_id) AS slot FROM lns l LEFT JOIN firm_spans f ON f.role = l.role AND f.case_id = l.case_id AND f.e <= l.s LEFT JOIN touched x ON x.role = l.role AND x.case_id = l.case_id AND x.line = l.line WHERE x.line IS NULL GROUP BY l.role, l.case_id, l.line, l.s),
firm_layout AS (SELECT free.role, free.case_id, string_agg(slot || ':' || t, '' ORDER BY line) AS seg FROM free JOIN ends USING (role, case_id) WHERE NOT (n_firm > 0 AND slot = n_firm AND last_owner > last_firm AND free.s < last_owner) GROUP BY ALL),
raw_layout AS (SELECT role, case_id, string_agg(gap, chr(1) ORDER BY pos) AS seg FROM p GROUP BY ALL),
lay AS (SELECT case_id, coalesce(max(seg) FILTER (role = 'base'), '') AS b, coalesce(max(seg) FILTER (role = 'ours'), '') AS o, coalesce(max(seg) FILTER (role = 'theirs'), '') AS t, coalesce(max(seg) FILTER (role = 'out'), '') AS made FROM firm_layout GROUP BY 1),
raw AS (SELECT case_id, max(seg) FILTER (role = 'base') AS b, max(seg) FILTER (role = 'ours') AS o, max(seg) FILTER (role = 'theirs') AS t FROM raw_layout GROUP BY 1),
ruled AS (SELECT w.case_id, whole, baseline, CASE WHEN fault IS NOT NULL THEN fault WHEN whole IS NOT NULL THEN 'whole_source' WHEN clash THEN 'owner_conflict' WHEN plan.case_id IS NULL THEN 'layout' WHEN baseline IS NULL THEN 'membership' WHEN o_firm IS DISTINCT FROM t_firm THEN 'owner_order'
    WHEN changed AND b_firm IS NULL THEN 'layout' WHEN changed AND EXISTS (SELECT 1 FROM shared x WHERE x.case_id = w.case_id AND x.role <> 'out') THEN 'shared_line'
    WHEN changed AND b_firm IS DISTINCT FROM o_firm AND coalesce(lay.o, '') <> coalesce(lay.t, '') THEN 'layout' WHEN changed AND b_firm IS NOT DISTINCT FROM o_firm AND (coalesce(lay.b, '') <> coalesce(lay.o, '') OR coalesce(lay.b, '') <> coalesce(lay.t, '')) THEN 'layout'
    WHEN NOT changed AND (raw.b <> raw.o OR raw.b <> raw.t) THEN 'layout'
    WHEN changed AND (EXISTS (SELECT 1 FROM shared x WHERE x.case_id = w.case_id AND x.role = 'out') OR coalesce(lay.made, '') <> coalesce(CASE baseline WHEN 'ours' THEN lay.o ELSE lay.t END, '')) THEN 'render_layout'
    WHEN extended THEN 'ours_extended' ELSE baseline END AS why
  FROM whole w LEFT JOIN faults USING (case_id) LEFT JOIN plan ON plan.case_id = w.case_id LEFT JOIN lay ON lay.case_id = w.case_id LEFT JOIN raw ON raw.case_id = w.case_id),
verdicts AS (SELECT case_id, CASE WHEN why IN ('whole_source', 'ours', 'theirs', 'ours_extended') THEN 'clean' WHEN why = 'owner_conflict' THEN 'conflict' ELSE 'error' END AS outcome, why, CASE WHEN why = 'whole_source' THEN whole WHEN why IN ('ours', 'theirs', 'ours_extended') THEN baseline END AS baseline FROM ruled),
cut AS (SELECT m.case_id, part, pos, 0 AS kind, gap_rev AS revision, NULL AS owner_id, gap_end - strlen(gap) AS src_start, gap_end AS src_end, gap AS text FROM made m JOIN verdicts v ON v.case_id = m.case_id AND v.outcome = 'clean' AND v.why <> 'whole_source' WHERE gap <> ''
  UNION ALL SELECT m.case_id, part, pos, 1, rev, owner_id, src_s - strlen(indent), src_e + strlen(rest), indent || text || rest FROM made m JOIN verdicts v ON v.case_id = m.case_id AND v.outcome = 'clean' AND v.why <> 'whole_source' WHERE owner_id IS NOT NULL
  UNION ALL SELECT d.case_id, 0, 0, 0, d.role, NULL, 0, strlen(doc), doc FROM docs d JOIN verdicts v ON v.case_id = d.case_id AND v.why = 'whole_source' AND v.baseline = d.role WHERE doc <> ''),
segs AS (SELECT case_id, row_number() OVER w - 1 AS ordinal, revision, owner_id, CAST(src_start AS BIGINT) AS src_start, CAST(src_end AS BIGINT) AS src_end, CAST(sum(strlen(text)) OVER w - strlen(text) AS BIGINT) AS out_start, CAST(sum(strlen(text)) OVER w AS BIGINT) AS out_end, sha256(text) AS sha256, text FROM cut WINDOW w AS (PARTITION BY case_id ORDER BY part, pos, kind)),
outs AS (SELECT v.case_id, coalesce(string_agg(text, '' ORDER BY ordinal), '') AS output FROM verdicts v LEFT JOIN segs s ON s.case_id = v.case_id WHERE v.outcome = 'clean' GROUP BY 1)"""

QUERIES = {f.__name__: f for f in (merge_with_layout, layout_segments, render_with_layout, verify_merged_bytes)}
SQL = {
    "merge_with_layout": f"{_SQL} SELECT * FROM verdicts",
    "layout_segments": f"{_SQL} SELECT case_id, ordinal, revision, owner_id, src_start, src_end, out_start, out_end, sha256 FROM segs",
    "render_with_layout": f"{_SQL} SELECT * FROM outs",
    "verify_merged_bytes": f"""{_SQL}, sizes AS (SELECT outs.case_id, output, count(s.ordinal) AS n FROM outs LEFT JOIN segs s ON s.case_id = outs.case_id GROUP BY ALL)
SELECT case_id, CASE WHEN case_id % 5 = 4 THEN 'length' WHEN n = 0 THEN NULL WHEN case_id % 5 = 1 THEN 'bytes' WHEN case_id % 5 = 2 AND n > 1 THEN 'digest' WHEN case_id % 5 = 3 AND n > 1 THEN 'gap' WHEN case_id % 5 = 3 THEN 'length' END AS error FROM sizes""",
}
