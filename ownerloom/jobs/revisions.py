"""Queries over revisions of owners (orders of each customer), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.jobs.demo_data import OWNERS_CTE, owners, revision, table
from ownerloom.operators import merging, reports

_BY_OWNER = f"""WITH {OWNERS_CTE},
r AS (SELECT case_id, owner_id,
  max(fingerprint) FILTER (role = 'base') AS b, max(fingerprint) FILTER (role = 'ours') AS o, max(fingerprint) FILTER (role = 'theirs') AS t,
  max(text) FILTER (role = 'base') AS bt, max(text) FILTER (role = 'ours') AS ot, max(text) FILTER (role = 'theirs') AS tt,
  max(path) FILTER (role = 'base') AS bpath, max(path) FILTER (role = 'ours') AS opath, max(path) FILTER (role = 'theirs') AS tpath,
  max(pos) FILTER (role = 'base') AS bp, max(pos) FILTER (role = 'ours') AS op, max(pos) FILTER (role = 'theirs') AS tp FROM owners GROUP BY ALL),
d AS (SELECT *, CASE
  WHEN b IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o = t OR b = t THEN 'select_ours' WHEN b = o THEN 'select_theirs' ELSE 'conflict_edit_edit' END
  WHEN b IS NOT NULL AND o IS NOT NULL THEN CASE WHEN b = o THEN 'delete' ELSE 'conflict_delete_modify' END
  WHEN b IS NOT NULL AND t IS NOT NULL THEN CASE WHEN b = t THEN 'delete' ELSE 'conflict_delete_modify' END
  WHEN b IS NOT NULL THEN 'delete'
  WHEN o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o = t THEN 'select_ours' ELSE 'conflict_add_add' END
  WHEN o IS NOT NULL THEN 'select_ours' ELSE 'select_theirs' END AS decision FROM r)"""


def three_way_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.three_way_classify(owners(spark, sf_dir)).select("case_id", "owner_id", "decision", "category", "selected")


def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merging.three_way_classify(owners(spark, sf_dir))
    return reports.decision_summary(rows.select("decision", F.coalesce("selected", F.lit("none")).alias("source")))


def whole_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.whole_source(owners(spark, sf_dir))


def merge_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In theirs of every third case, orders with numbers divisible by 5 come first and backwards."""
    turned = (F.col("role") == "theirs") & (F.col("case_id") % 3 == 0) & (F.col("owner_id") % 5 == 0)
    rows = owners(spark, sf_dir).withColumn("pos", F.when(turned, -F.col("pos")).otherwise(F.col("pos")))
    return merging.merge_preconditions(rows, merging.three_way_classify(rows))


def owner_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.owner_diff(revision(spark, sf_dir, "base"), revision(spark, sf_dir, "ours"))


def directional_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.directional_classify(revision(spark, sf_dir, "theirs"), revision(spark, sf_dir, "ours"))


def owner_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.owner_union(owners(spark, sf_dir)).select("case_id", "owner_id", F.col("rank").cast("long").alias("rank"))


def match_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda role: revision(spark, sf_dir, role).select("case_id", F.col("text").alias("path"), "pos")
    return merging.match_by_path(side("base"), side("theirs")).select("case_id", "path", F.col("occurrence").cast("long").alias("occurrence"), "template_pos", "destination_pos")


def merge_comment_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return merging.merge_comment_delta(part.select(k.alias("case_id"), F.when(k % 4 != 0, F.col("p_type")).alias("base"), F.when(k % 3 != 0, F.when(k % 5 == 0, F.col("p_brand")).otherwise(F.col("p_type"))).alias("ours"), F.when(k % 2 != 0, F.when(k % 7 == 0, F.col("p_name")).otherwise(F.col("p_type"))).alias("theirs"))).select("case_id", "merged", "conflict")


_COMMENT_SQL = """WITH c AS (SELECT p_partkey AS case_id, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS b,
  CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END END AS o,
  CASE WHEN p_partkey % 2 <> 0 THEN CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE p_type END END AS t FROM part)
SELECT case_id, CASE WHEN o IS NOT DISTINCT FROM t OR b IS NOT DISTINCT FROM t THEN o WHEN b IS NOT DISTINCT FROM o THEN t END AS merged,
  CASE WHEN o IS NOT DISTINCT FROM t OR b IS NOT DISTINCT FROM t OR b IS NOT DISTINCT FROM o THEN NULL WHEN o IS NULL OR t IS NULL THEN 'delete_edit' ELSE 'edit_edit' END AS conflict FROM c"""


def merge_keyed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linenumber") <= 3, "base").when(F.col("l_linenumber") <= 5, "left").otherwise("right")
    return merging.merge_keyed_members(li.groupBy(F.col("l_orderkey").alias("case_id"), "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p")).select("case_id", side.alias("side"), F.col("l_linenumber").alias("pos"), (F.col("s") % 3).cast("string").alias("key"), (F.col("p") % 4).cast("string").alias("value"))).select("case_id", "key", "value", F.col("rank").cast("long").alias("rank"), "resolved")


_KEYED_SQL = """WITH m AS (SELECT l_orderkey AS case_id, l_linenumber AS pos, CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 5 THEN 1 ELSE 2 END AS side,
  CAST(min(l_suppkey) % 3 AS VARCHAR) AS key, CAST(min(l_partkey) % 4 AS VARCHAR) AS value FROM lineitem GROUP BY ALL),
k AS (SELECT case_id, key, min(pos) AS first, arg_max(value, pos) AS value, arg_max(value, pos) FILTER (side = 1) AS l,
  min(value) FILTER (side = 2) AS r0, max(value) FILTER (side = 2) AS r1 FROM m GROUP BY ALL),
c AS (SELECT *, coalesce(l IS NOT NULL AND (r0 <> l OR r1 <> l), false) AS clash FROM k),
w AS (SELECT *, bool_or(clash) OVER (PARTITION BY case_id) AS bad, row_number() OVER (PARTITION BY case_id ORDER BY first) - 1 AS rank FROM c)
SELECT case_id, CASE WHEN NOT bad THEN key END AS key, CASE WHEN NOT bad THEN value END AS value, rank, NOT bad AS resolved FROM w WHERE NOT bad OR rank = 0"""


def union_commutative_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    nodes = part.select((k % 50).alias("case_id"), F.when(k % 50 < 40, "commutative").otherwise("ordered").alias("parent_policy"), F.when(k % 3 == 0, "base").when(k % 3 == 1, "left").otherwise("right").alias("side"), k.alias("pos"), k.cast("string").alias("node_id"), F.when(k % 4 != 0, F.col("p_name")).alias("signature"))
    return merging.union_commutative_children(nodes).select("case_id", "node_id", F.col("rank").cast("long").alias("rank"), "resolved")


_UNION_SQL = """WITH n AS (SELECT p_partkey % 50 AS case_id, p_partkey AS pos, CAST(p_partkey AS VARCHAR) AS node_id, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN 1 ELSE 2 END AS side,
  CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS k FROM part WHERE p_partkey % 50 < 40),
f AS (SELECT case_id, node_id, side, pos FROM n QUALIFY row_number() OVER (PARTITION BY case_id, k ORDER BY side, pos) = 1)
SELECT case_id, node_id, row_number() OVER (PARTITION BY case_id ORDER BY side, pos) - 1 AS rank, true AS resolved FROM f
UNION ALL SELECT DISTINCT p_partkey % 50, NULL, NULL, false FROM part WHERE p_partkey % 50 >= 40"""


def merge_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    suffix = F.when(k % 5 == 0, ".json").when(k % 7 == 0, ".MD").otherwise(".bin")
    path = F.concat(F.when(k % 31 == 0, "../").when(k % 3 == 0, "./a//").otherwise("a/b/../"), k.cast("string"), suffix)
    base = part.select((k % 10).alias("case_id"), path.alias("path"), F.lit("deflate").alias("compression"), F.col("p_size").cast("long").alias("compressed_size"), F.col("p_size").cast("long").alias("uncompressed_size"), F.md5("p_name").alias("crc32"), (k % 41 == 0).alias("encrypted"), k.alias("k"))
    current = base.where("k % 11 <> 0").withColumn("role", F.lit("current"))
    incoming = base.where("k % 13 <> 0").withColumn("crc32", F.when(F.col("k") % 2 == 0, F.md5("crc32")).otherwise(F.col("crc32"))).withColumn("role", F.lit("incoming"))
    return merging.merge_archive_entries(base.withColumn("role", F.lit("ancestor")).unionByName(current).unionByName(incoming).drop("k")).select("case_id", "normalized_path", "operation", "nested_family", "reason")


_ARCHIVE_SQL = """WITH e AS (SELECT p_partkey AS k, p_partkey % 10 AS case_id, (CASE WHEN k % 31 = 0 THEN '' ELSE 'a/' END) || k || (CASE WHEN k % 5 = 0 THEN '.json' WHEN k % 7 = 0 THEN '.MD' ELSE '.bin' END) AS normalized_path FROM part)
SELECT case_id, normalized_path, operation, CASE WHEN operation = 'delegate' THEN family END AS nested_family, reason FROM (
  SELECT *, CASE WHEN reason IS NOT NULL THEN 'reject' WHEN k % 11 = 0 THEN 'add' WHEN k % 13 = 0 THEN 'delete' WHEN k % 2 <> 0 THEN 'preserve' WHEN family IS NOT NULL THEN 'delegate' ELSE 'rewrite' END AS operation FROM (
    SELECT case_id, k, normalized_path,
      CASE WHEN k % 5 = 0 THEN 'json' WHEN k % 7 = 0 THEN 'markdown' END AS family,
      CASE WHEN k % 13 = 0 THEN NULL WHEN k % 31 = 0 THEN 'path_traversal' WHEN k % 41 = 0 THEN 'encrypted' END AS reason FROM e WHERE NOT (k % 11 = 0 AND k % 13 = 0)))"""


def structural_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    node = lambda sig, pos: part.select((k % 20).alias("case_id"), sig.alias("signature"), F.lit("root").alias("parent"), pos.alias("pos"), F.md5(F.concat(F.col("p_name"), k.cast("string"))).alias("body_hash"))
    before = node(F.concat(F.lit("f"), k.cast("string")), k)
    after = node(F.when(k % 9 == 0, F.concat(F.lit("g"), k.cast("string"))).otherwise(F.concat(F.lit("f"), k.cast("string"))), F.when(k % 8 == 0, k + 1).otherwise(k))
    return merging.structural_matches(before, after).select("case_id", "signature", "to_signature", "kind", F.col("distance").cast("long").alias("distance"))


_MATCH_SQL = """SELECT p_partkey % 20 AS case_id, 'f' || p_partkey AS signature, CASE WHEN p_partkey % 9 = 0 THEN 'g' ELSE 'f' END || p_partkey AS to_signature,
  CASE WHEN p_partkey % 9 = 0 THEN 'rename' ELSE 'moved' END AS kind, CAST(CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS distance
FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 8 = 0"""


def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = owners(spark, sf_dir)
    sequence = F.when(F.col("role") == "base", 0).when(F.col("role") == "ours", 1).otherwise(2)
    selected = merging.three_way_classify(rows).where("selected IS NOT NULL").select("case_id", F.coalesce("ours_pos", "theirs_pos").alias("pos"), F.col("owner_id").alias("node_id"))
    out = merging.merge_order(rows.select("case_id", sequence.alias("sequence"), "pos", F.col("owner_id").alias("node_id")), selected)
    return out.select("case_id", "status", F.array_join("node_ids", ",").alias("node_ids"))


def render_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = owners(spark, sf_dir)
    return merging.render_merged(rows, merging.three_way_classify(rows))


def render_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.render_conflicts(merging.three_way_classify(owners(spark, sf_dir)))


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = owners(spark, sf_dir)
    return merging.merged_segments(rows, merging.three_way_classify(rows))


def render_conflict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and how many regions are found in them again."""
    from ownerloom.operators import cutting

    rows = owners(spark, sf_dir)
    docs = merging.render_conflict_documents(rows, merging.three_way_classify(rows))
    lines = cutting.doc_lines(docs.select(F.col("case_id").alias("doc_id"), F.col("output").alias("text")))
    found = cutting.conflict_regions(lines)[0].groupBy(F.col("doc_id").alias("case_id")).agg(F.count("*").alias("n_found"))
    return docs.join(found, "case_id", "left").select("case_id", F.md5("output").alias("digest"), "n_conflicts", "n_found")


def sequence_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theirs against base; in theirs, orders with numbers divisible by 5 come first and backwards."""
    theirs = revision(spark, sf_dir, "theirs").withColumn("pos", F.when(F.col("owner_id") % 5 == 0, -F.col("pos")).otherwise(F.col("pos")))
    return merging.sequence_changes(revision(spark, sf_dir, "base"), theirs).select("case_id", "owner_id", "kind", "base_pos", "side_pos")


def merge_owner_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owners that all revisions have, in the order that the tips agree on; in ours of every second case they stand backwards."""
    rows = owners(spark, sf_dir).withColumn("pos", F.when((F.col("role") == "ours") & (F.col("case_id") % 2 == 0), -F.col("pos")).otherwise(F.col("pos")))
    stable = rows.groupBy("case_id", "owner_id").agg(F.count("*").alias("n")).where("n = 3").select("case_id", "owner_id")
    out = merging.merge_owner_order(rows.join(stable.select("case_id").distinct(), "case_id", "left_semi"), stable)
    return out.select("case_id", "status", F.array_join("owner_ids", ",").alias("owner_ids"))


_OWNER_ORDER_SQL = f"""{_BY_OWNER} SELECT case_id, 'ordered' AS status, string_agg(CAST(owner_id AS VARCHAR), ',' ORDER BY CASE WHEN case_id % 2 = 0 THEN -bp ELSE bp END) AS owner_ids FROM d WHERE bp + op + tp IS NOT NULL GROUP BY 1"""


def sequence_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tips of some cases turn owners around, in the same way or not."""
    rows = owners(spark, sf_dir)
    turn = lambda m, r: (F.col("role") == r) & (F.col("case_id") % m == 0) & (F.col("owner_id") % 5 == 0) | (F.col("role") == r) & (F.col("case_id") % 7 == 0) & (F.col("owner_id") % 3 == 0)
    rows = rows.withColumn("pos", F.when(turn(2, "ours") | turn(3, "theirs"), -F.col("pos")).otherwise(F.col("pos")))
    part = lambda role: rows.where(F.col("role") == role)
    return merging.sequence_conflicts(part("base"), part("ours"), part("theirs")).select("case_id", "category", "owner_id", "base_pos")


_ORDER_SQL = f"""{_BY_OWNER}, p AS (SELECT case_id, owner_id, bp, CASE WHEN (case_id % 2 = 0 AND owner_id % 5 = 0) OR (case_id % 7 = 0 AND owner_id % 3 = 0) THEN -op ELSE op END AS op, CASE WHEN (case_id % 3 = 0 AND owner_id % 5 = 0) OR (case_id % 7 = 0 AND owner_id % 3 = 0) THEN -tp ELSE tp END AS tp FROM d),
l AS (SELECT case_id, list(bp ORDER BY op) FILTER (bp IS NOT NULL AND op IS NOT NULL) AS o, list(bp ORDER BY tp) FILTER (bp IS NOT NULL AND tp IS NOT NULL) AS t FROM p GROUP BY 1)
SELECT case_id, CASE decision WHEN 'conflict_delete_modify' THEN 'delete_modify' WHEN 'conflict_edit_edit' THEN 'modify_modify' ELSE 'duplicate_insertion' END AS category, owner_id, bp AS base_pos FROM d WHERE decision LIKE 'conflict%'
UNION ALL SELECT case_id, 'order', NULL, NULL FROM l WHERE o <> t AND o <> list_sort(o) AND t <> list_sort(t)"""


QUERIES = {
    f.__name__: f
    for f in (three_way_classify, decision_summary, whole_source, merge_preconditions, owner_diff, directional_classify, owner_union, match_by_path, merge_comment_delta, merge_keyed_members, union_commutative_children, sequence_changes, sequence_conflicts, merge_archive_entries, structural_matches, merge_order, merge_owner_order, render_merged, merged_segments, render_conflicts, render_conflict_documents)
}

_SELECTED = "CASE decision WHEN 'select_ours' THEN 'ours' WHEN 'select_theirs' THEN 'theirs' END"
SQL = {
    "three_way_classify": f"{_BY_OWNER} SELECT case_id, owner_id, decision, CASE WHEN decision = 'conflict_add_add' THEN 'add_add' WHEN decision LIKE 'conflict%' THEN 'edit_edit' END AS category, {_SELECTED} AS selected FROM d",
    "decision_summary": f"{_BY_OWNER}, s AS (SELECT decision, coalesce({_SELECTED}, 'none') AS source FROM d) SELECT CASE WHEN grouping(decision) = 0 THEN 'decision' ELSE 'source' END AS dimension, coalesce(decision, source) AS value, count(*) AS n FROM s GROUP BY GROUPING SETS ((decision), (source))",
    "whole_source": f"""WITH {OWNERS_CTE}, s AS (SELECT case_id, coalesce(string_agg(owner_id || ':' || fingerprint, ',' ORDER BY pos) FILTER (role = 'base'), '') AS b, coalesce(string_agg(owner_id || ':' || fingerprint, ',' ORDER BY pos) FILTER (role = 'ours'), '') AS o, coalesce(string_agg(owner_id || ':' || fingerprint, ',' ORDER BY pos) FILTER (role = 'theirs'), '') AS t FROM owners GROUP BY 1)
SELECT case_id, CASE WHEN o = t OR b = t THEN 'ours' WHEN b = o THEN 'theirs' END AS whole_source FROM s""",
    "merge_preconditions": f"""{_BY_OWNER}, p AS (SELECT * REPLACE (CASE WHEN case_id % 3 = 0 AND owner_id % 5 = 0 THEN -tp ELSE tp END AS tp) FROM d),
s AS (SELECT case_id, string_agg(owner_id || ':' || bp || ':' || b, ',' ORDER BY bp) FILTER (bp IS NOT NULL) AS bs, string_agg(owner_id || ':' || op || ':' || o, ',' ORDER BY op) FILTER (op IS NOT NULL) AS os, string_agg(owner_id || ':' || tp || ':' || t, ',' ORDER BY tp) FILTER (tp IS NOT NULL) AS ts,
  string_agg(CAST(owner_id AS VARCHAR), ',' ORDER BY op) FILTER (bp + op + tp IS NOT NULL) IS DISTINCT FROM string_agg(CAST(owner_id AS VARCHAR), ',' ORDER BY tp) FILTER (bp + op + tp IS NOT NULL) AS turned,
  count(*) FILTER (decision LIKE 'conflict%') AS conflicts, count(*) FILTER (decision LIKE 'select%' AND op IS NULL) AS bo, count(*) FILTER (decision NOT LIKE 'select%' AND op IS NOT NULL) AS lo, count(*) FILTER (decision LIKE 'select%' AND tp IS NULL) AS bt_, count(*) FILTER (decision NOT LIKE 'select%' AND tp IS NOT NULL) AS lt FROM p GROUP BY 1),
w AS (SELECT case_id, CASE WHEN os IS NOT DISTINCT FROM ts OR bs IS NOT DISTINCT FROM ts THEN 'whole_source_ours' WHEN bs IS NOT DISTINCT FROM os THEN 'whole_source_theirs' WHEN conflicts > 0 THEN 'owner_conflict' WHEN lo > 0 AND NOT (bt_ = 0 AND lt = 0) THEN 'membership'
  WHEN turned THEN 'owner_order' WHEN bo = 0 AND lo = 0 THEN 'ours' WHEN bt_ = 0 AND lt = 0 THEN 'theirs' ELSE 'ours_extended' END AS why FROM s)
SELECT case_id, CASE why WHEN 'owner_conflict' THEN 'conflict' WHEN 'membership' THEN 'error' WHEN 'owner_order' THEN 'error' ELSE 'clean' END AS outcome, why FROM w""",
    "owner_diff": f"""{_BY_OWNER}, c AS (SELECT case_id, owner_id, bp, op, bpath AS before_path, opath AS after_path, CASE WHEN bp IS NULL THEN 'added' WHEN op IS NULL THEN 'deleted' WHEN bt <> ot OR bpath <> opath THEN 'edited' END AS change FROM d WHERE bp IS NOT NULL OR op IS NOT NULL)
SELECT case_id, owner_id, change, 'change-' || (row_number() OVER (PARTITION BY case_id ORDER BY bp IS NULL, coalesce(bp, op)) - 1) AS change_id, before_path, after_path FROM c WHERE change IS NOT NULL""",
    "directional_classify": f"{_BY_OWNER} SELECT case_id, owner_id, CASE WHEN opath <> tpath THEN NULL WHEN tp IS NULL THEN 'retain_current_only' WHEN op IS NULL THEN 'add_incoming_only' WHEN ot = tt THEN 'retain_identical_current' ELSE 'prefer_current' END AS decision, CASE WHEN opath <> tpath THEN 'owner_path_changed' END AS error FROM d WHERE op IS NOT NULL OR tp IS NOT NULL",
    "owner_union": f"""WITH {OWNERS_CTE}, f AS (SELECT case_id, owner_id, min(CASE role WHEN 'base' THEN 0 WHEN 'ours' THEN 1 ELSE 2 END) AS r, arg_min(pos, CASE role WHEN 'base' THEN 0 WHEN 'ours' THEN 1 ELSE 2 END) AS p FROM owners GROUP BY ALL)
SELECT case_id, owner_id, row_number() OVER (PARTITION BY case_id ORDER BY r, p) - 1 AS rank FROM f""",
    "match_by_path": f"""WITH {OWNERS_CTE}, n AS (SELECT role, case_id, text AS path, pos, row_number() OVER (PARTITION BY role, case_id, text ORDER BY pos) AS occurrence FROM owners)
SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.path, b.path) AS path, coalesce(a.occurrence, b.occurrence) AS occurrence, a.pos AS template_pos, b.pos AS destination_pos
FROM (SELECT * FROM n WHERE role = 'base') a FULL JOIN (SELECT * FROM n WHERE role = 'theirs') b ON a.case_id = b.case_id AND a.path = b.path AND a.occurrence = b.occurrence""",
    "sequence_changes": f"""WITH {OWNERS_CTE}, b AS (SELECT * FROM owners WHERE role = 'base'), t AS (SELECT * EXCLUDE (pos), CASE WHEN owner_id % 5 = 0 THEN -pos ELSE pos END AS pos FROM owners WHERE role = 'theirs'),
m AS (SELECT b.case_id, b.owner_id, b.pos AS base_pos, t.pos AS side_pos, b.text <> t.text AS changed FROM b JOIN t ON b.case_id = t.case_id AND b.owner_id = t.owner_id),
n AS (SELECT *, lag(base_pos) OVER wb IS DISTINCT FROM lag(base_pos) OVER ws OR lead(base_pos) OVER wb IS DISTINCT FROM lead(base_pos) OVER ws AS moved FROM m WINDOW wb AS (PARTITION BY case_id ORDER BY base_pos), ws AS (PARTITION BY case_id ORDER BY side_pos))
SELECT case_id, owner_id, 'modify' AS kind, base_pos, side_pos FROM n WHERE changed UNION ALL SELECT case_id, owner_id, 'move', base_pos, side_pos FROM n WHERE moved
UNION ALL SELECT case_id, owner_id, 'delete', pos, NULL FROM b ANTI JOIN m USING (case_id, owner_id) UNION ALL SELECT case_id, owner_id, 'insert', NULL, pos FROM t ANTI JOIN m USING (case_id, owner_id)""",
    "merged_segments": f"""{_BY_OWNER}, c AS (SELECT case_id, owner_id, CASE decision WHEN 'select_ours' THEN 'ours' ELSE 'theirs' END AS revision, CASE decision WHEN 'select_ours' THEN ot ELSE tt END AS x, op, tp FROM d WHERE decision LIKE 'select%' AND case_id NOT IN (SELECT case_id FROM d WHERE decision LIKE 'conflict%')),
s AS (SELECT *, CAST(sum(strlen(x) + 1) OVER (PARTITION BY case_id ORDER BY op IS NULL, coalesce(op, tp)) AS BIGINT) AS e FROM c) SELECT case_id, owner_id AS segment_id, revision, e - strlen(x) - 1 AS out_start, e - 1 AS out_end, sha256(x) AS sha256 FROM s""",
    "render_conflict_documents": f"""{_BY_OWNER}, k AS (SELECT *, decision LIKE 'conflict%' AS hit FROM d), p AS (SELECT case_id, hit, CASE WHEN op IS NOT NULL THEN 0 WHEN tp IS NOT NULL THEN 1 ELSE 2 END AS side, coalesce(op, tp, bp) AS pos,
  CASE WHEN hit THEN '<<<<<<< ours' || chr(10) || coalesce(ot || chr(10), '') || '||||||| base' || chr(10) || coalesce(bt || chr(10), '') || '=======' || chr(10) || coalesce(tt || chr(10), '') || '>>>>>>> theirs' ELSE ot END AS x FROM k WHERE op IS NOT NULL OR hit)
SELECT case_id, md5(string_agg(x, chr(10) ORDER BY side, pos) || chr(10)) AS digest, count(*) FILTER (hit) AS n_conflicts, count(*) FILTER (hit) AS n_found FROM p GROUP BY 1 HAVING bool_or(hit)""",
    "sequence_conflicts": _ORDER_SQL,
    "merge_owner_order": _OWNER_ORDER_SQL,
    "merge_comment_delta": _COMMENT_SQL,
    "merge_keyed_members": _KEYED_SQL,
    "union_commutative_children": _UNION_SQL,
    "merge_archive_entries": _ARCHIVE_SQL,
    "structural_matches": _MATCH_SQL,
    "render_merged": f"""{_BY_OWNER} SELECT case_id, string_agg(CASE decision WHEN 'select_ours' THEN ot ELSE tt END, chr(10) ORDER BY op IS NULL, coalesce(op, tp)) AS output, count(*) AS n_owners FROM d
WHERE decision LIKE 'select%' AND case_id NOT IN (SELECT case_id FROM d WHERE decision LIKE 'conflict%') GROUP BY 1""",
    "render_conflicts": f"""{_BY_OWNER} SELECT case_id, owner_id, '<<<<<<< ours' || chr(10) || coalesce(ot || chr(10), '') || '||||||| base' || chr(10) || coalesce(bt || chr(10), '') || '=======' || chr(10) || coalesce(tt || chr(10), '') || '>>>>>>> theirs' || chr(10) AS block FROM d WHERE decision LIKE 'conflict%'""",
}
