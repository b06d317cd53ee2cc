"""Queries over comments and line dispositions of documents, and their SQL.

The SQL says of each comment which lines must not lie between it and an owner; the operators count over windows instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.jobs.demo_data import LINES_CTE, lines
from ownerloom.operators import comments
from ownerloom.sources.scratch import written

#: What a line of a document stands for, in SQL that Spark and DuckDB both run: 0-1 blank, 2-5 comment, 6-7 owner, 8 owner with a comment beside it, 9 other.
_CLASS = "(length(text) * 7 + line * 3 + doc_id) % 10"


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, owners, comments) of all documents."""
    rows = lines(spark, sf_dir).withColumn("c", F.expr(_CLASS))
    text = F.when(F.col("c") < 2, " ").otherwise(F.concat(F.lit("x"), "text"))
    own = rows.where("c IN (6, 7, 8)").select("doc_id", F.concat(F.lit("o"), "line").alias("owner_id"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.expr("line % 2").alias("indent"))
    notes = rows.where("c IN (2, 3, 4, 5, 8)").select("doc_id", "line", (F.col("c") != 8).alias("full_line"), F.expr("IF(c = 2, 1, 0)").alias("indent"))
    return rows.select("doc_id", "line", text.alias("text")), own, notes


def _regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, own, notes = _marked(spark, sf_dir)
    return rows, own, comments.attach_comments(rows, own, notes)


def attach_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of comments of all documents."""
    regions = _regions(spark, sf_dir)[2]
    return regions.select("doc_id", "kind", "owner_id", "selection_key", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line", "n_comments")], "floating")


_REGIONS_CTE = f"""{LINES_CTE}, k AS (SELECT doc_id, line, {_CLASS} AS c FROM lines),
o AS (SELECT doc_id, line AS s, 'o' || line AS owner_id, line % 2 AS indent, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS next_s, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS prev_s FROM k WHERE c IN (6, 7, 8)),
f AS (SELECT doc_id, line, CASE WHEN c = 2 THEN 1 ELSE 0 END AS indent FROM k WHERE c BETWEEN 2 AND 5),
around AS (SELECT f.*, (SELECT max(s) FROM o WHERE o.doc_id = f.doc_id AND o.s < f.line) AS above, (SELECT min(s) FROM o WHERE o.doc_id = f.doc_id AND o.s > f.line) AS below FROM f),
trail_of AS (SELECT a.doc_id, a.line, a.above FROM around a WHERE above IS NOT NULL AND EXISTS (SELECT 1 FROM f WHERE f.doc_id = a.doc_id AND f.line = a.above + 1)
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = a.doc_id AND k.line > a.above AND k.line <= a.line AND (k.c = 9 OR (k.c BETWEEN 2 AND 5 AND (CASE WHEN k.c = 2 THEN 1 ELSE 0 END) <> a.above % 2)))),
lead0 AS (SELECT a.doc_id, a.line, a.below FROM around a WHERE below IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trail_of t WHERE t.doc_id = a.doc_id AND t.line = a.line)
  AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = a.doc_id AND k.line > a.line AND k.line < a.below AND k.c = 9)),
blank1 AS (SELECT doc_id, min(line) AS b FROM k WHERE c < 2 GROUP BY 1),
lead_of AS (SELECT l.doc_id, l.line, l.below FROM lead0 l LEFT JOIN blank1 USING (doc_id) WHERE NOT (EXISTS (SELECT 1 FROM lead0 x WHERE x.doc_id = l.doc_id AND x.below = l.below AND x.line = 1) AND b IS NOT NULL AND b < l.below AND l.line <= b)),
post AS (SELECT doc_id, line FROM around a WHERE below IS NULL AND above IS NOT NULL AND NOT EXISTS (SELECT 1 FROM trail_of t WHERE t.doc_id = a.doc_id AND t.line = a.line)),
rest AS (SELECT f.doc_id, f.line FROM f WHERE (doc_id, line) NOT IN (SELECT (doc_id, line) FROM trail_of UNION ALL SELECT (doc_id, line) FROM lead_of UNION ALL SELECT (doc_id, line) FROM post)),
steps AS (SELECT doc_id, line, lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM rest),
parted AS (SELECT s.doc_id, s.line, CASE WHEN p IS NULL OR EXISTS (SELECT 1 FROM k WHERE k.doc_id = s.doc_id AND k.line > s.p AND k.line < s.line AND k.c >= 2) THEN 1 ELSE 0 END AS cut FROM steps s),
grouped AS (SELECT doc_id, line, sum(cut) OVER (PARTITION BY doc_id ORDER BY line) AS g FROM parted),
gs AS (SELECT doc_id, g, min(line) AS a, max(line) AS z FROM grouped GROUP BY 1, 2),
first_own AS (SELECT doc_id, min(s) AS s FROM o GROUP BY 1),
heads AS (SELECT gs.doc_id, gs.g, CASE WHEN gs.a = 1 THEN (SELECT max(line) FROM k WHERE k.doc_id = gs.doc_id AND k.c < 2 AND k.line > gs.a AND k.line < gs.z) END AS gap FROM gs JOIN first_own fo ON fo.doc_id = gs.doc_id WHERE gs.g = 1 AND gs.z < fo.s),
own_kind AS (SELECT r.doc_id, r.line, r.g, CASE WHEN h.g IS NOT NULL AND (h.gap IS NULL OR r.line < h.gap) THEN 'preamble' ELSE 'orphan' END AS kind FROM grouped r LEFT JOIN heads h ON h.doc_id = r.doc_id AND h.g = r.g),
parts AS (SELECT doc_id, 'trailing' AS kind, 'o' || above AS owner_id, 0 AS g, line FROM trail_of UNION ALL SELECT doc_id, 'leading', 'o' || below, 0, line FROM lead_of UNION ALL SELECT doc_id, 'postlude', NULL, 0, line FROM post
  UNION ALL SELECT doc_id, kind, NULL, g, line FROM own_kind UNION ALL SELECT doc_id, 'inline', 'o' || line, 0, line FROM k WHERE c = 8),
regions AS (SELECT doc_id, kind, owner_id, min(line) AS start_line, max(line) AS end_line, count(*) AS n_comments FROM parts GROUP BY doc_id, kind, owner_id, g),
keyed AS (SELECT *, CASE WHEN owner_id IS NOT NULL THEN 'comment:' || owner_id || ':' || kind WHEN kind = 'orphan' THEN 'root:orphan:' || (row_number() OVER (PARTITION BY doc_id, kind ORDER BY start_line) - 1) ELSE 'root:' || kind END AS selection_key,
  kind = 'leading' AND CAST(substr(owner_id, 2) AS BIGINT) - end_line > 1 AS floating FROM regions)"""
_REGIONS_SQL = f"WITH {_REGIONS_CTE} SELECT doc_id, kind, owner_id, selection_key, start_line, end_line, n_comments, coalesce(floating, false) AS floating FROM keyed"


def line_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disposition of every line of all documents."""
    rows, own, regions = _regions(spark, sf_dir)
    regions = written(comments.regions_in_owners(regions, own), "regions")
    out, errors = comments.line_dispositions(rows, own, regions, written(comments.edge_gaps(rows, own, regions), "gaps"))
    told = errors.groupBy("doc_id").agg(F.min("code").alias("kind")).select("doc_id", F.lit(None).cast("long").alias("line"), "kind")
    return out.select("doc_id", F.col("line").cast("long").alias("line"), "kind", "selection_key", "owner_id", F.array_join("region_ids", ",").alias("region_ids"), "comment_kind", "root_kind", "gap_id", "controller").unionByName(told, allowMissingColumns=True)


_DISPOSITIONS_SQL = f"""WITH {_REGIONS_CTE},
x AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM k WHERE c < 2), runs AS (SELECT doc_id, min(line) AS s, max(line) AS e FROM x GROUP BY doc_id, g),
edges AS (SELECT r.*, a.owner_id AS above, b.owner_id AS below, t.owner_id AS t_above, l.owner_id AS l_below FROM runs r LEFT JOIN o a ON a.doc_id = r.doc_id AND a.s + 1 = r.s LEFT JOIN o b ON b.doc_id = r.doc_id AND b.s - 1 = r.e
  LEFT JOIN keyed t ON t.doc_id = r.doc_id AND t.kind = 'trailing' AND t.end_line + 1 = r.s LEFT JOIN keyed l ON l.doc_id = r.doc_id AND l.kind = 'leading' AND l.start_line - 1 = r.e),
gaps AS (SELECT doc_id, s, e, 'layout-gap:' || s || '-' || e AS gap_id, coalesce(above, t_above) AS p, coalesce(below, l_below) AS n, CASE WHEN coalesce(below, l_below) IS NULL OR (above IS NOT NULL AND below IS NULL) THEN coalesce(above, t_above) ELSE coalesce(below, l_below) END AS controller FROM edges WHERE coalesce(above, t_above, below, l_below) IS NOT NULL),
inl AS (SELECT * FROM keyed WHERE kind = 'inline'),
d AS (SELECT k.doc_id, k.line, o.owner_id AS own, r.kind AS rk, r.owner_id AS ro, r.selection_key AS rkey, 'comment-region:' || r.kind || ':' || r.start_line || '-' || r.end_line AS rid, i.selection_key AS ikey, g.gap_id, g.controller, g.p, g.n
  FROM k LEFT JOIN o ON o.doc_id = k.doc_id AND o.s = k.line LEFT JOIN keyed r ON r.doc_id = k.doc_id AND r.kind <> 'inline' AND k.line BETWEEN r.start_line AND r.end_line
  LEFT JOIN inl i ON i.doc_id = k.doc_id AND i.start_line = k.line LEFT JOIN gaps g ON g.doc_id = k.doc_id AND k.line BETWEEN g.s AND g.e),
faults AS (SELECT doc_id, CASE WHEN min(m) > 0 THEN 'region_conflict' ELSE 'gap_conflict' END AS code FROM (SELECT doc_id, line, count(*) AS m, CASE WHEN count(*) > 1 OR (max(own) IS NOT NULL AND max(rk) IS NOT NULL) THEN 1 ELSE 0 END AS clash, CASE WHEN max(gap_id) IS NOT NULL AND max(rk) IS NOT NULL THEN 1 ELSE 0 END AS gap_clash FROM d GROUP BY 1, 2) WHERE clash = 1 OR gap_clash = 1 GROUP BY 1)
SELECT doc_id, line, CASE WHEN own IS NOT NULL THEN 'structural_owner' WHEN ro IS NOT NULL THEN 'comment_owner' WHEN rk IS NOT NULL THEN 'root_region' WHEN gap_id IS NOT NULL THEN 'layout_gap' ELSE 'unmanaged' END AS kind,
  CASE WHEN own IS NOT NULL THEN 'owner:' || own WHEN rk IS NOT NULL THEN rkey WHEN gap_id IS NOT NULL THEN 'gap:' || CASE WHEN p IS NULL THEN 'preamble' WHEN n IS NULL THEN 'postlude' ELSE 'interstitial' END || ':' || coalesce(p, 'root') || ':' || coalesce(n, 'root') ELSE 'unmanaged:' || line END AS selection_key,
  coalesce(own, ro) AS owner_id, CASE WHEN ikey IS NOT NULL THEN 'comment-region:inline:' || line || '-' || line ELSE coalesce(rid, '') END AS region_ids, CASE WHEN ikey IS NOT NULL THEN 'inline' WHEN ro IS NOT NULL THEN rk END AS comment_kind,
  CASE WHEN rk IS NOT NULL AND ro IS NULL THEN rk END AS root_kind, gap_id, controller FROM d WHERE doc_id NOT IN (SELECT doc_id FROM faults)
UNION ALL SELECT doc_id, NULL, code, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM faults"""

QUERIES = {f.__name__: f for f in (attach_comments, line_dispositions)}
SQL = {"attach_comments": _REGIONS_SQL, "line_dispositions": _DISPOSITIONS_SQL}
