"""Queries over inventories, observations, results and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.functions.scalars import is_rfc3339_utc
from ownerloom.jobs.demo_data import table
from ownerloom.operators import cutting, ingest, paths, reports
from ownerloom.sources.scratch import written


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    chunk = F.when(F.col("l_partkey") % 101 == 0, "").otherwise(F.concat(F.lit("c"), (F.col("l_linenumber") % 6).cast("string")))
    return li.select(F.lit("p").alias("producer_id"), F.col("l_orderkey").alias("scope"), F.lit("r1").alias("revision_ref"), chunk.alias("chunk_id"), F.col("l_linenumber").cast("long").alias("ordinal"), F.md5(F.col("l_partkey").cast("string")).alias("content_hash"))


def validate_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validate_inventory(_chunks(spark, sf_dir)).select("scope", "n", "violation")


_INVENTORY = "c AS (SELECT l_orderkey AS scope, CASE WHEN l_partkey % 101 = 0 THEN '' ELSE 'c' || l_linenumber % 6 END AS chunk_id, l_linenumber AS ordinal FROM lineitem)"
_INVENTORY_SQL = f"""WITH {_INVENTORY} SELECT scope, count(*) AS n, 'empty_field' AS violation FROM c WHERE chunk_id = '' GROUP BY 1
UNION ALL SELECT scope, count(*), 'duplicate_id' FROM (SELECT scope, chunk_id FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT scope, count(*), 'duplicate_ordinal' FROM (SELECT scope, ordinal FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY 1"""


def inventory_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    row = lambda h: orders.select(F.col("o_custkey").alias("scope"), k.alias("chunk_id"), h.alias("content_hash"))
    prior = row(F.col("o_orderstatus")).where("chunk_id % 5 <> 0")
    current = row(F.when(k % 4 == 0, "changed").otherwise(F.col("o_orderstatus"))).where("chunk_id % 7 <> 0")
    return ingest.inventory_delta(prior, current)


_DELTA_SQL = """SELECT o_custkey AS scope, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'updated' END AS change
FROM orders WHERE (o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0) OR (o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 4 = 0)"""


def accept_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.accept_observations(_observations(spark, sf_dir)).select("scope", "observation_id", "seq", "decision", "head")


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of a user's chain; some repeat the one before, some name a wrong head."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w)
    rows = e.select(F.col("user_id").cast("string").alias("scope"), n.cast("long").alias("seq"))
    prior = F.when(F.col("seq") % 10 == 1, F.when(F.col("seq") > 1, F.concat(F.lit("r"), (F.col("seq") - 3).cast("string")))).when(F.col("seq") % 10 == 0, "nowhere").otherwise(F.concat(F.lit("r"), (F.col("seq") - F.when(F.col("seq") % 10 == 9, 2).otherwise(1)).cast("string")))
    ident = F.when(F.col("seq") % 10 == 8, F.col("seq") - 1).otherwise(F.col("seq")).cast("string")
    return rows.select(F.lit("p").alias("producer_id"), "scope", ident.alias("observation_id"), "seq", ident.alias("payload_digest"), F.concat(F.lit("r"), "seq").alias("revision_ref"), prior.alias("expected_prior"), F.lit("x").alias("projection"))


#: A payload of an event, in SQL that Spark and DuckDB both run: fields that are missing, unknown or wrong by the event's number.
_PAYLOAD = """concat('{"producer":"p","scope":"s","observation_id":"', e, '","revision_ref":"r', e, '","source_revision_ref":null,"expected_prior_revision_ref":', CASE WHEN e % 6 = 0 THEN 'null' WHEN e % 6 = 1 THEN '"zz"' ELSE concat('"r', e - 1, '"') END,
  ',"prior_inventory":[],"current_inventory":[],"added":[],"updated":[],"removed":[],"original":{},"normalized":{},"processing":{},"times":{},"scan":{},"deletion":{}', CASE WHEN e % 11 = 0 THEN '' ELSE ',"evidence_refs":[]' END, CASE WHEN e % 13 = 0 THEN ',"other":1' ELSE '' END,
  CASE WHEN e % 5 = 0 THEN '' WHEN e % 5 = 1 THEN ',"revision_parents":[]' WHEN e % 5 = 2 THEN concat(',"revision_parents":["r', e - 1, '"]') WHEN e % 5 = 3 THEN concat(',"revision_parents":["q","r', e - 1, '"]') ELSE concat(',"revision_parents":["r', CASE WHEN e % 4 = 0 THEN e ELSE e - 1 END, '"]') END,
  CASE WHEN e % 7 = 0 THEN ',"source_time_start":"2024-01-02T00:00:00Z"' WHEN e % 7 = 1 THEN ',"source_time_start":"2024-01-02T00:00:00Z","source_time_end":"2024-01-01T00:00:00Z"' WHEN e % 7 = 2 THEN ',"source_time_start":"2024-01-02T00:00:00Z","source_time_end":"2024-02-30T00:00:00Z"' WHEN e % 7 = 3 THEN ',"source_time_start":"2024-01-02T00:00:00Z","source_time_end":"2024-01-03T00:00:00Z"' ELSE '' END,
  ',"extensions":', CASE WHEN e % 17 = 0 THEN '{' ELSE '{}' END, CASE WHEN e % 19 = 0 THEN ',"scan":1}' ELSE '}' END)"""


def check_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("e")).withColumn("payload_json", F.expr(_PAYLOAD))
    digest = F.when(F.col("e") % 23 == 0, "0").otherwise(F.sha2("payload_json", 256))
    return ingest.check_envelope(rows.select(F.col("e").alias("observation_key"), F.when(F.col("e") % 29 == 0, "v0").otherwise("v1").alias("schema"), "payload_json", digest.alias("payload_digest")), "v1")


_ENVELOPE_SQL = """SELECT event_id AS observation_key, CASE WHEN e % 29 = 0 THEN 'schema' WHEN e % 23 = 0 THEN 'payload_digest' WHEN e % 17 = 0 OR e % 19 = 0 THEN 'json' WHEN e % 7 = 0 THEN 'time' WHEN e % 13 = 0 OR e % 11 = 0 THEN 'fields'
  WHEN e % 5 = 1 AND e % 6 <> 0 THEN 'ancestry' WHEN e % 5 IN (2, 3) AND e % 6 = 1 THEN 'ancestry' WHEN e % 5 = 4 AND (e % 4 = 0 OR e % 6 = 1) THEN 'ancestry' WHEN e % 7 IN (1, 2) THEN 'time' END AS code FROM (SELECT event_id, event_id AS e FROM events)"""


def run_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    results = li.select(F.col("l_returnflag").alias("extension"), F.concat(F.lit("repo"), (F.col("l_suppkey") % 10).cast("string")).alias("repository"), F.when(F.col("l_linestatus") == "O", "completed").otherwise("failed").alias("status"), F.col("l_quantity").alias("seconds"), (F.col("l_partkey") % 3 == 0).alias("markers"), (F.col("l_partkey") % 2 == 0).alias("exact"))
    out = reports.run_scorecard(results)
    return out.select("dimension", "value", "cases", "applied", "clean", "exact", F.round("safety", 9).alias("safety"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), F.round("throughput", 9).alias("throughput"))


_SCORE_SQL = """WITH r AS (SELECT l_returnflag AS extension, 'repo' || l_suppkey % 10 AS repository, l_linestatus = 'O' AS a, l_quantity AS s, l_partkey % 3 = 0 AS m, l_partkey % 2 = 0 AS e FROM lineitem)
SELECT CASE WHEN grouping(extension) = 0 THEN 'extension' WHEN grouping(repository) = 0 THEN 'repository' ELSE 'all' END AS dimension, coalesce(extension, repository, 'all') AS value, count(*) AS cases, count(*) FILTER (a) AS applied, count(*) FILTER (a AND NOT m) AS clean, count(*) FILTER (a AND NOT m AND e) AS exact,
  round(count(*) FILTER (a AND NOT m AND e)::DOUBLE / nullif(count(*) FILTER (a AND NOT m), 0), 9) AS safety, round(quantile_disc(s, 0.5), 6) AS p50, round(quantile_disc(s, 0.95), 6) AS p95, round(count(*) / sum(s), 9) AS throughput
FROM r GROUP BY GROUPING SETS ((extension), (repository), ())"""


#: Outcomes of the demo: one that no run has, one that the contract does not list, a false merge and both excluded ones.
_OUTCOMES = ("clean_exact", "conflict", "false_auto_merge", "unsupported", "excluded_ambiguous", "surprise")


def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    outcome = F.when((F.col("l_suppkey") % 4 == 3) & (F.col("l_partkey") % 6 == 2), "conflict").otherwise(F.element_at(F.array(*[F.lit(o) for o in _OUTCOMES]), (F.col("l_partkey") % 6 + 1).cast("int")))
    results = li.select((F.col("l_suppkey") % 4).alias("run_id"), F.col("l_partkey").alias("case_id"), outcome.alias("outcome"))
    known = spark.createDataFrame([(o,) for o in (*_OUTCOMES[:-1], "error")], "outcome string")
    return reports.benchmark_summary(results, known, part.select(F.col("p_partkey").alias("case_id"), (F.col("p_partkey") % 5 > 0).alias("score_eligible")))


_BENCH_SQL = """WITH r AS (SELECT l_suppkey % 4 AS run_id, CASE WHEN l_suppkey % 4 = 3 AND l_partkey % 6 = 2 THEN 'conflict' ELSE ['clean_exact', 'conflict', 'false_auto_merge', 'unsupported', 'excluded_ambiguous', 'surprise'][l_partkey % 6 + 1] END AS outcome, coalesce(p_partkey % 5 > 0, false) AS ok FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
t AS (SELECT run_id, count(*) FILTER (ok AND outcome NOT IN ('unsupported', 'excluded_ambiguous')) AS eligible, count(*) FILTER (outcome IN ('unsupported', 'excluded_ambiguous')) AS excluded, count(*) FILTER (ok AND outcome = 'false_auto_merge') AS false_auto_merges FROM r GROUP BY 1),
o AS (SELECT unnest(['clean_exact', 'conflict', 'false_auto_merge', 'unsupported', 'excluded_ambiguous', 'error']) AS outcome, true AS known), g AS (SELECT run_id, outcome, known FROM t CROSS JOIN o UNION ALL SELECT DISTINCT run_id, outcome, false FROM r WHERE outcome NOT IN (SELECT outcome FROM o))
SELECT g.run_id, g.outcome, g.known, count(r.run_id) AS n, t.eligible, t.excluded, t.false_auto_merges, CASE WHEN t.false_auto_merges = 0 THEN 'pass' ELSE 'fail' END AS safety FROM g JOIN t USING (run_id) LEFT JOIN r ON r.run_id = g.run_id AND r.outcome = g.outcome GROUP BY ALL"""


def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "passed").when(F.col("l_linenumber") == 1, "skipped").otherwise("failed")
    return reports.suite_summary(li.select(F.col("l_returnflag").alias("suite"), status.alias("status")))


_SUITE_SQL = """SELECT l_returnflag AS suite, count(*) AS total, count(*) FILTER (l_linestatus = 'O') AS passed, count(*) FILTER (l_linestatus <> 'O' AND l_linenumber <> 1) AS failed, count(*) FILTER (l_linestatus <> 'O' AND l_linenumber = 1) AS skipped FROM lineitem GROUP BY ROLLUP (l_returnflag)"""


def score_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    out = (
        F.when(k == 0, F.concat(F.regexp_replace("text", "\n", " \t\n"), F.lit(" \n"))).when(k == 1, F.concat("text", F.lit("\n=======\n"))).when(k == 2, F.concat("text", F.lit("\n\n")))
        .when(k == 3, F.regexp_replace("text", "\n", "\r")).when(k == 4, F.concat(F.lit("\n"), "text")).otherwise(F.col("text"))
    )
    return reports.score_agreement(docs.select(F.col("doc_id").alias("case_id"), F.col("text").alias("expected"), out.alias("output")))


_LINES = "list_transform(string_split(CASE WHEN ends_with({u}, chr(10)) THEN left({u}, length({u}) - 1) ELSE {u} END, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(11) || chr(12)))"
_AGREE_SQL = f"""WITH d AS (SELECT doc_id AS case_id, text AS e, CASE doc_id % 6 WHEN 0 THEN replace(text, chr(10), ' ' || chr(9) || chr(10)) || ' ' || chr(10) WHEN 1 THEN text || chr(10) || '=======' || chr(10) WHEN 2 THEN text || chr(10) || chr(10)
  WHEN 3 THEN replace(text, chr(10), chr(13)) WHEN 4 THEN chr(10) || text ELSE text END AS o FROM documents),
u AS (SELECT *, replace(replace(o, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS uo, replace(replace(e, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS ue FROM d)
SELECT case_id, o = e AS exact, (o = '') = (e = '') AND {_LINES.format(u="uo")} = {_LINES.format(u="ue")} AS normalized, contains(o, '=======') OR contains(o, '<<<<<<<') AS markers, sha256(o) AS sha256 FROM u"""


def pair_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    adapter = lambda a, m, o: orders.where(f"o_orderkey % {m} <> 0").select((F.col("o_custkey") % 3).alias("run_id"), F.col("o_orderkey").alias("case_id"), F.lit(a).alias("adapter_id"), F.col(o).alias("outcome"))
    return reports.pair_results(adapter("git", 5, "o_orderstatus").unionByName(adapter("own", 7, "o_orderpriority")), "git", "own")


_PAIR_SQL = """SELECT o_custkey % 3 AS run_id, o_orderkey AS case_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS base_outcome, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS candidate_outcome,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'dangling_pair' END AS violation FROM orders WHERE o_orderkey % 35 <> 0"""


def check_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return reports.check_references(orders.where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("case_id")), li.where("l_orderkey % 8 <> 0").select(F.col("l_orderkey").alias("case_id")))


_REFS_SQL = """WITH c AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 9 <> 0), r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 8 <> 0)
SELECT id, 'duplicate_case' AS violation FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT id, 'dangling_case' FROM r WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT id, 'missing_result' FROM (SELECT DISTINCT id FROM c) WHERE id NOT IN (SELECT id FROM r)"""


def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cases = orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("case_id"))
    return reports.review_groups(cases, cases.where("case_id % 9 <> 0"), cases.where("group_id % 2 = 0"))


_REVIEW_SQL = """SELECT o_custkey AS group_id, count(*) AS cases, count(*) FILTER (o_orderkey % 9 <> 0) AS resolved, count(*) FILTER (o_orderkey % 9 = 0) = 0 AS ready, o_custkey % 2 = 0 AND count(*) FILTER (o_orderkey % 9 = 0) = 0 AS applied FROM orders GROUP BY 1"""


def is_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    bad = F.when(F.col("event_id") % 5 == 0, F.concat(text, F.lit("+00:00"))).when(F.col("event_id") % 7 == 0, F.regexp_replace(F.concat(text, F.lit("Z")), "^(.{5})..", "$113")).otherwise(F.concat(text, F.lit(".25Z")))
    return e.select("event_id", is_rfc3339_utc(bad).alias("valid"))


def plan_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    name = F.when(k % 10 == 0, ".settings.yml").when(k % 10 == 1, ".env.local").otherwise(F.concat(F.lit("d/"), k.cast("string"), F.when(k % 2 == 0, ".yml").otherwise(".md")))
    templates = pages.select("page_id", F.concat(name, F.when(k % 3 == 0, ".no-osc.example").when(k % 3 == 1, ".example").otherwise("")).alias("template_source_path"))
    overrides = pages.where("page_id % 4 = 2").select(F.concat(F.lit("./d/"), k.cast("string"), F.lit(".yml")).alias("path"), F.lit("keep_destination").alias("strategy"), k.alias("override_order"))
    there = pages.where("page_id % 5 = 3").select(F.concat(F.lit("d/"), k.cast("string"), F.when(k % 2 == 0, ".yml").otherwise(".md")).alias("destination_path"))
    out = paths.plan_template_execution(paths.plan_template_paths(templates, overrides, omitted=(".settings.yml",)), there)
    return out.select("page_id", "destination_path", "strategy", "action", "write_action", "execution_action", "ready")


_TEMPLATES_SQL = """WITH t AS (SELECT page_id AS k, CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN '.env.local.example' ELSE 'd/' || k || CASE WHEN k % 2 = 0 THEN '.yml' ELSE '.md' END END AS destination_path,
  CASE WHEN k % 4 = 2 AND k % 10 <> 0 THEN 'keep_destination' ELSE 'merge' END AS strategy FROM pages),
w AS (SELECT *, CASE WHEN destination_path IS NULL THEN 'omit' WHEN strategy = 'keep_destination' THEN 'keep' WHEN k % 5 = 3 THEN 'update' ELSE 'create' END AS write_action FROM t)
SELECT k AS page_id, destination_path, strategy, CASE WHEN destination_path IS NULL THEN 'omit' ELSE strategy END AS action, write_action,
  CASE write_action WHEN 'omit' THEN 'omit' WHEN 'keep' THEN 'keep' WHEN 'create' THEN 'write' ELSE 'merge' END AS execution_action, write_action IN ('create', 'update') AS ready FROM w"""


def resolve_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    rows = pages.select(F.concat((k % 5).cast("string"), F.lit("/"), k.cast("string"), F.when(k % 2 == 0, ".json").otherwise(".md")).alias("path"))
    rules = spark.createDataFrame([("", 1, "*.json", "language", "json"), ("", 2, "*", "conflict-marker-size", "9"), ("3", 1, "*.md", "language", "text"), ("3", 2, "3/*.json", "language", "jsonc"), ("4", 1, "*", "conflict-marker-size", "0"), ("2", 1, "*", "profile", "strict")], "directory string, rule_order int, pattern string, key string, value string")
    return paths.resolve_path_attributes(rows, rules).select("path", "language", "profile", F.col("marker_size").cast("long").alias("marker_size"))


_ATTRIBUTES_SQL = """SELECT (page_id % 5) || '/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '.md' END AS path,
  CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 5 = 3 THEN 'jsonc' ELSE 'json' END WHEN page_id % 5 = 3 THEN 'text' END AS language, CASE WHEN page_id % 5 = 2 THEN 'strict' END AS profile, 9::BIGINT AS marker_size FROM pages"""


def shard_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cases = orders.select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 40).cast("string")).alias("repository"), F.when(F.col("o_orderkey") % 10 != 0, F.floor("o_totalprice")).alias("estimated_input_bytes"))
    told, _ = reports.assign_shards(cases, 6)
    return told.groupBy("repository").agg(F.min("shard").alias("shard"), F.max("shard").alias("shard_max"), F.count("*").alias("cases"))


def check_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared changes of every second chunk against those that the inventories show."""
    declared = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 3 == 0, "removed").otherwise("updated").alias("change"))
    return ingest.check_delta(declared, inventory_delta(spark, sf_dir))


_CHECK_DELTA_SQL = f"""WITH d AS ({_DELTA_SQL}), c AS (SELECT o_custkey AS scope, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN 'removed' ELSE 'updated' END AS change FROM orders WHERE o_orderkey % 2 = 0)
SELECT c.scope, c.chunk_id, c.change, CASE WHEN d.change IS NULL THEN 'unchanged_or_unknown' ELSE 'wrong_change' END AS code FROM c LEFT JOIN d ON d.scope = c.scope AND d.chunk_id = c.chunk_id WHERE d.change IS DISTINCT FROM c.change"""


def check_incorporation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for each order about its first two lines; references, outcomes and evidence are wrong by its number."""
    orders, li = table(spark, sf_dir, "orders").dropDuplicates(["o_orderkey"]), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    chunks = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("scope"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("chunk_id"), F.col("l_linenumber").cast("long").alias("ordinal"))
    ref = lambda n, o: F.struct(F.lit(f"c{n}").alias("chunk_id"), F.lit(o).cast("long").alias("ordinal"))
    none = F.array().cast("array<struct<chunk_id:string,ordinal:bigint>>")
    outcome = F.when(k % 7 == 0, "odd").when(k % 3 == 0, "ignored").otherwise("edited")
    rows = orders.select(k.alias("scope"), F.lit("d").alias("decision_id"), F.when(k % 11 == 0, "").otherwise("a").alias("authority_ref"), F.when(k % 5 == 0, F.array(ref(1, 1), ref(2, 2))).otherwise(F.array(ref(1, 1))).alias("source_refs"), F.when(k % 4 == 0, none).when(k % 13 == 0, F.array(ref(1, 2))).otherwise(F.array(ref(1, 1))).alias("subject_refs"), outcome.alias("outcome"), F.when(k % 2 == 0, F.array(F.lit("e"))).otherwise(F.array(F.lit("f"))).alias("evidence_refs"))
    rows = rows.unionByName(rows.where("scope % 17 = 0").withColumn("authority_ref", F.lit("b")))
    evidence = orders.select(k.alias("scope"), F.lit("e").alias("evidence_ref"))
    return ingest.check_incorporation(rows, evidence, chunks, chunks)


_INCORPORATION_SQL = """WITH c AS (SELECT l_orderkey AS k, bool_or(l_linenumber = 1) AS one, bool_or(l_linenumber = 2) AS two FROM lineitem GROUP BY 1),
o AS (SELECT DISTINCT o_orderkey AS k FROM orders), r AS (SELECT k, k % 11 = 0 AS e FROM o UNION ALL SELECT k, false FROM o WHERE k % 17 = 0)
SELECT r.k AS scope, 'd' AS decision_id, CASE WHEN e THEN 'empty_field' WHEN r.k % 17 = 0 THEN 'duplicate_decision' WHEN r.k % 7 = 0 THEN 'outcome' WHEN NOT coalesce(one, false) OR (r.k % 5 = 0 AND NOT coalesce(two, false)) THEN 'unknown_source'
  WHEN r.k % 4 <> 0 AND (r.k % 13 = 0 OR NOT coalesce(one, false)) THEN 'unknown_subject' WHEN r.k % 4 = 0 AND r.k % 3 <> 0 THEN 'no_subject' WHEN r.k % 2 <> 0 THEN 'unknown_evidence' END AS code FROM r LEFT JOIN c ON c.k = r.k"""


def select_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases, regions as the profiles of their families."""
    k, r = F.col("p_partkey"), F.col("r_regionkey").cast("string")
    named = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    cases = table(spark, sf_dir, "part").select(k.alias("case_id"), named("f", k % 7).alias("family"), named("b", k % 3).alias("backend"), F.when(k % 4 > 0, named("d", k % 5)).alias("dialect"), F.array(named("p", k % 3), named("p", k % 4)).alias("policies"))
    profiles = table(spark, sf_dir, "region").select(named("f", r).alias("family"), F.array(F.lit("b0"), named("b", r)).alias("known_backends"), F.array(F.lit("d0"), named("d", r)).alias("known_dialects"), F.array(F.lit("p0"), F.lit("p1"), named("p", r)).alias("known_policies"))
    return reports.select_cases(cases, profiles)


_SELECT_SQL = """WITH c AS (SELECT p_partkey AS k, p_partkey % 7 AS f, 'b' || p_partkey % 3 AS b, CASE WHEN p_partkey % 4 > 0 THEN 'd' || p_partkey % 5 END AS d, ['p' || p_partkey % 3, 'p' || p_partkey % 4] AS ps FROM part),
m AS (SELECT k, concat_ws(',', CASE WHEN r_regionkey IS NULL OR b NOT IN ('b0', 'b' || r_regionkey) THEN 'backend' END, CASE WHEN d IS NOT NULL AND (r_regionkey IS NULL OR d NOT IN ('d0', 'd' || r_regionkey)) THEN 'dialect' END,
  CASE WHEN r_regionkey IS NULL OR len(list_filter(ps, lambda x: x NOT IN ('p0', 'p1', 'p' || r_regionkey))) > 0 THEN 'policy' END) AS skip_reasons FROM c LEFT JOIN region ON r_regionkey = f)
SELECT k AS case_id, skip_reasons, skip_reasons = '' AS selected FROM m"""


def promotion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as providers under the regions' policies, and whether they are available at least."""
    k, r = F.col("s_suppkey"), F.col("r_regionkey")
    metrics = table(spark, sf_dir, "supplier").select(k.alias("provider"), F.concat(F.lit("f"), (k % 6).cast("string")).alias("family"), (k % 10 > 0).alias("hard_gate_passed"), (k % 8).alias("fixtures"), (k % 7 > 0).alias("formatting_preserved"), (k % 4).alias("fallbacks"), (k % 5).alias("conflicts"), (k % 9 > 0).alias("parity"))
    policy = table(spark, sf_dir, "region").select(F.concat(F.lit("f"), r.cast("string")).alias("family"), (r + 1).alias("min_fixtures"), r.alias("max_fallbacks"), (r + 1).alias("max_conflicts"))
    return reports.promotion_status(metrics, policy).withColumn("enough", reports.meets_status(F.col("status"), F.lit("available")))


_PROMOTION_SQL = """WITH m AS (SELECT s_suppkey AS k, s_suppkey % 6 AS f, r_regionkey AS r FROM supplier LEFT JOIN region ON r_regionkey = s_suppkey % 6),
t AS (SELECT k, f, concat_ws(',', CASE WHEN k % 10 = 0 THEN 'hard_gate' END, CASE WHEN k % 8 < coalesce(r + 1, 1) THEN 'fixture_count' END, CASE WHEN k % 7 = 0 THEN 'formatting' END, CASE WHEN k % 4 > coalesce(r, 0) THEN 'fallbacks' END, CASE WHEN k % 5 > coalesce(r + 1, 0) THEN 'conflicts' END, CASE WHEN k % 9 = 0 THEN 'parity' END) AS reasons FROM m),
s AS (SELECT *, CASE WHEN contains(reasons, 'hard_gate') OR contains(reasons, 'fixture_count') THEN 'experimental' WHEN reasons <> '' THEN 'available' ELSE 'recommended' END AS status FROM t)
SELECT k AS provider, 'f' || f AS family, reasons, status, status <> 'experimental' AS enough FROM s"""


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan_templates(spark, sf_dir)
    k = F.col("page_id")
    execution = F.when(k % 12 == 5, "blocked").otherwise(F.col("execution_action"))
    return rows.select((k % 5).alias("run_id"), execution.alias("execution_action"), "write_action", F.col("ready").alias("ready"), (F.col("ready") & (k % 2 == 0)).alias("written"), (k % 3 == 0).alias("differs"))


def template_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _applied(spark, sf_dir)
    return reports.template_report(rows).join(reports.template_convergence(rows), "run_id")


_REPORT_SQL = f"""WITH p AS ({_TEMPLATES_SQL}), a AS (SELECT page_id % 5 AS run_id, CASE WHEN page_id % 12 = 5 THEN 'blocked' ELSE execution_action END AS x, write_action AS w, ready, ready AND page_id % 2 = 0 AS written, page_id % 3 = 0 AS differs FROM p)
SELECT run_id, count(*) FILTER (w = 'create' AND written) AS created, count(*) FILTER (w = 'update' AND written) AS updated, count(*) FILTER (x = 'keep') AS kept, count(*) FILTER (x = 'blocked') AS blocked, count(*) FILTER (x = 'omit') AS omitted, count(*) FILTER (written) AS written,
  bool_and(x <> 'blocked' AND NOT (ready AND differs)) AS converged FROM a GROUP BY 1"""


def check_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions about the lines of orders: their chunks keep or swap their contents, or are not there."""
    orders, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    chunks = li.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("scope"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("chunk_id")).agg(F.min("l_partkey").cast("string").alias("content_hash"))
    turned = F.when(F.col("chunk_id") == "c1", "c2").otherwise("c1")
    current = chunks.withColumn("chunk_id", F.when(F.col("scope") % 2 == 0, turned).otherwise(F.col("chunk_id"))).withColumn("content_hash", F.when(F.col("scope") % 5 == 0, "new").otherwise(F.col("content_hash")))
    chunks, current = chunks.withColumn("ordinal", F.lit(0).cast("long")), current.withColumn("ordinal", F.col("scope") % 2)
    kind = F.element_at(F.array(*map(F.lit, ("merge", "rename", "reorder", "move", "copy", "split", "join", "reorder"))), (k % 8 + 1).cast("int"))
    status = F.when(k % 17 == 0, "sure").when(k % 6 == 0, "ambiguous").otherwise("asserted")
    refs = lambda *names, at: F.array(*[F.struct(F.lit(x).alias("chunk_id"), at.cast("long").alias("ordinal")) for x in names])
    none = F.array().cast("array<struct<chunk_id:string,ordinal:bigint>>")
    prior_refs = F.when(k % 7 == 0, refs("c9", at=F.lit(0))).when(k % 31 == 0, none).otherwise(refs("c1", "c2", at=F.lit(0)))
    current_refs = F.when(k % 29 == 0, refs("", at=F.lit(0))).otherwise(refs("c1", "c2", at=F.when(k % 37 == 0, 5).otherwise(k % 2)))
    basis = F.element_at(F.array(*map(F.lit, ("authored", "algorithmic", "unknown", "guess"))), F.when(k % 41 == 0, 4).otherwise(k % 3 + 1).cast("int"))
    rows = orders.select(k.alias("scope"), F.lit("a").alias("assertion_id"), kind.alias("kind"), status.alias("status"), prior_refs.alias("prior_refs"), current_refs.alias("current_refs"), basis.alias("basis"), F.when((k % 3 == 0) | (k % 43 == 0), "A").alias("authority_ref"), F.when(k % 3 == 1, "diff").alias("algorithm_id"), F.when((k % 3 == 1) & (k % 47 != 0), "1").alias("algorithm_version"), F.when(k % 13 == 0, 1.5).when(k % 5 == 1, 0.5).alias("confidence"))
    return ingest.check_lineage(rows, chunks, current)


def decide_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations of what was known and is left of their lines; two producers share each scope."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.expr(_DELETION_MODE).alias("mode")).distinct()
    orders = written(orders, "deletion-orders")
    # Six sets are made of it, and the decisions are read twice.
    held = written(table(spark, sf_dir, "lineitem").select(k.alias("k"), F.concat(F.lit("c"), n).alias("chunk_id"), n.alias("n")).distinct().join(orders, "k"), "deletion-lines")
    keyed = lambda df, *more: df.select(F.concat(F.lit("p"), F.col("k") % 2).alias("producer_id"), F.expr("k div 8").alias("scope"), F.col("k").alias("observation_id"), *more)
    chosen = held.where(_DELETION_TARGETS)
    observations = keyed(orders, "mode", F.expr("CASE WHEN mode <> 'none' OR k % 50 = 3 THEN k END").alias("authority_ref"), F.expr("CASE WHEN k % 19 = 0 THEN 'partial' ELSE 'complete' END").alias("status"), F.expr("CASE WHEN k % 3 = 0 THEN 'f' END").alias("finalization_ref"))
    authorities = orders.where("k % 21 <> 0").select(F.col("k").alias("authority_ref"), F.expr("concat('p', CASE WHEN k % 22 = 0 THEN 1 - k % 2 ELSE k % 2 END)").alias("producer_id"), F.expr("k div 8").alias("scope"), F.expr("CASE WHEN k % 26 = 0 THEN 'none' ELSE mode END").alias("mode"), F.expr("CASE WHEN k % 3 = 0 AND k % 27 <> 0 THEN 'f' END").alias("finalization_ref"))
    granted = chosen.where("NOT (k % 17 = 0 AND n = 2)").select(F.col("k").alias("authority_ref"), "chunk_id")
    decided = ingest.decide_deletions(observations, keyed(chosen, "chunk_id"), keyed(held.where(_DELETION_REMOVED), "chunk_id"), keyed(held, "chunk_id"), keyed(held.where(f"NOT ({_DELETION_REMOVED})"), "chunk_id"), authorities, granted)
    decided = written(decided, "deletions")
    dead = ingest.tombstones(decided, keyed(chosen, "chunk_id")).groupBy("observation_id").agg(F.count("*").alias("n_tombstones"))
    return decided.join(dead, "observation_id", "left").select("producer_id", "scope", "observation_id", "n_targets", "code", F.coalesce("n_tombstones", F.lit(0)).alias("n_tombstones"))


#: Modes, what an observation no longer has and what it wants deleted, in SQL that Spark and DuckDB both run.
_DELETION_MODE = "CASE o_orderkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'explicit_source' WHEN 2 THEN 'absence' WHEN 3 THEN 'none' WHEN 4 THEN 'explicit_source' WHEN 5 THEN 'absence' WHEN 6 THEN 'absence' ELSE 'odd' END"
_DELETION_REMOVED = "(mode = 'explicit_source' AND NOT (k % 15 = 0 AND n = 1)) OR (mode <> 'explicit_source' AND n % 2 = 0)"
_DELETION_TARGETS = "(mode = 'explicit_source' AND NOT (k % 14 = 0 AND n = 1)) OR (mode = 'absence' AND (n % 2 = 0 OR (k % 23 = 0 AND n = 1))) OR (mode = 'none' AND k % 25 = 0 AND n = 1)"
_DELETIONS_SQL = f"""WITH o AS (SELECT DISTINCT o_orderkey AS k, {_DELETION_MODE} AS mode FROM orders), h AS (SELECT DISTINCT l_orderkey AS k, 'c' || l_linenumber AS c, l_linenumber AS n, mode FROM lineitem JOIN o ON o.k = l_orderkey),
s AS (SELECT o.k, o.mode, coalesce(list_sort(list(c) FILTER ({_DELETION_TARGETS.replace("k %", "h.k %").replace("mode", "h.mode")})), []) AS t, coalesce(list_sort(list(c) FILTER ({_DELETION_REMOVED.replace("k %", "h.k %").replace("mode", "h.mode")})), []) AS r, coalesce(list_sort(list(c)), []) AS p,
  coalesce(list_sort(list(c) FILTER (({_DELETION_TARGETS.replace("k %", "h.k %").replace("mode", "h.mode")}) AND NOT (h.k % 17 = 0 AND n = 2))), []) AS g FROM o LEFT JOIN h ON h.k = o.k GROUP BY o.k, o.mode),
l AS (SELECT k, mode, list_filter(t, lambda x: x IS NOT NULL) AS t, list_filter(r, lambda x: x IS NOT NULL) AS r, list_filter(p, lambda x: x IS NOT NULL) AS p, list_filter(g, lambda x: x IS NOT NULL) AS g FROM s),
d AS (SELECT *, CASE mode WHEN 'none' THEN CASE WHEN k % 50 = 3 OR len(t) > 0 THEN 'deletion' END WHEN 'absence' THEN CASE WHEN k % 19 = 0 OR t <> r THEN 'deletion' END WHEN 'explicit_source' THEN CASE WHEN r <> p OR t <> p THEN 'deletion' END ELSE 'deletion' END AS c1 FROM l),
e AS (SELECT *, coalesce(c1, CASE WHEN mode <> 'none' AND (k % 21 = 0 OR k % 22 = 0 OR k % 26 = 0 OR k % 27 = 0 OR t <> g) THEN 'authority' END) AS code FROM d)
SELECT 'p' || k % 2 AS producer_id, k // 8 AS scope, k AS observation_id, len(t) AS n_targets, code, CASE WHEN code IS NULL AND mode <> 'none' THEN len(t) ELSE 0 END AS n_tombstones FROM e"""


_LINEAGE_SQL = """WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(min(l_partkey) AS VARCHAR) AS h FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), s AS (SELECT k, count(*) AS n FROM c GROUP BY 1),
o AS (SELECT DISTINCT o_orderkey AS k, coalesce(s.n, 0) AS n FROM orders LEFT JOIN s ON s.k = o_orderkey)
SELECT k AS scope, 'a' AS assertion_id, CASE WHEN k % 8 < 2 THEN 'kind' WHEN k % 17 = 0 THEN 'status' WHEN k % 29 = 0 THEN 'reference' WHEN k % 41 = 0 OR (k % 43 = 0 AND k % 3 <> 0) OR (k % 3 = 1 AND k % 47 = 0) THEN 'provenance' WHEN k % 13 = 0 THEN 'confidence'
  WHEN k % 6 = 0 THEN NULL WHEN k % 31 = 0 AND k % 7 <> 0 THEN 'empty_side' WHEN k % 7 = 0 OR n < 2 THEN 'unknown_prior' WHEN k % 37 = 0 THEN 'unknown_current' WHEN k % 8 IN (2, 7) AND k % 5 = 0 THEN 'reorder_changes_content' END AS code FROM o"""


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as templates with tokens: some valid, some not, some without a replacement."""
    k = F.col("page_id")
    text = F.concat(F.lit("{no} x {A|"), (k % 50).cast("string"), F.lit("} {B|C:D} {A|"), (k % 50).cast("string"), F.lit("} {e-f|g} {Z|q:"), (k % 7).cast("string"), F.lit(":w} {A|{B|C} end"))
    return table(spark, sf_dir, "pages").select(k.alias("doc_id"), text.alias("text"), F.when(k % 9 == 0, "raw_copy").otherwise("merge").alias("strategy"), F.when(k % 8 != 0, F.concat(F.lit("d/"), k.cast("string"))).alias("destination_path"))


def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutting.template_tokens(_templates(spark, sf_dir)).select("doc_id", F.array_join("keys", ",").alias("keys"))


_TOKENS_SQL = "SELECT page_id AS doc_id, 'A|' || page_id % 50 || ',B|C:D,Z|q:' || page_id % 7 || ':w' AS keys FROM pages"


def resolve_template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    known = pages.where("page_id < 50 AND page_id % 5 <> 0").select(F.concat(F.lit("A|"), F.col("page_id").cast("string")).alias("key"), F.concat(F.lit("a"), F.col("page_id").cast("string")).alias("replacement"))
    known = known.unionByName(pages.where("page_id < 7 AND page_id <> 3").select(F.concat(F.lit("Z|q:"), F.col("page_id").cast("string"), F.lit(":w")).alias("key"), F.lit("{B|C:D}").alias("replacement")))
    known = known.unionByName(pages.where("page_id = 1").select(F.lit("B|C:D").alias("key"), F.lit("").alias("replacement")))
    return cutting.resolve_template_tokens(_templates(spark, sf_dir), known).select("doc_id", F.array_join("unresolved", ",").alias("unresolved"), "blocked", "text")


_RESOLVE_SQL = """WITH t AS (SELECT page_id AS k, 'A|' || page_id % 50 AS a, 'Z|q:' || page_id % 7 || ':w' AS z, (page_id % 50) % 5 <> 0 AS has_a, page_id % 7 <> 3 AS has_z, page_id % 8 <> 0 AND page_id % 9 <> 0 AS needed FROM pages)
SELECT k AS doc_id, concat_ws(',', CASE WHEN NOT has_a THEN a END, CASE WHEN NOT has_z THEN z END) AS unresolved, needed AND NOT (has_a AND has_z) AS blocked,
  CASE WHEN NOT needed THEN '{no} x {' || a || '} {B|C:D} {' || a || '} {e-f|g} {' || z || '} {A|{B|C} end' WHEN has_a AND has_z THEN '{no} x a' || k % 50 || '  a' || k % 50 || ' {e-f|g} {B|C:D} {A|{B|C} end' END AS text FROM t"""


QUERIES = {
    f.__name__: f
    for f in (validate_inventory, inventory_delta, check_envelope, accept_observations, run_scorecard, benchmark_summary, suite_summary, score_agreement, pair_results, check_references, review_groups, is_rfc3339, plan_templates, resolve_attributes, shard_loads, check_delta, check_lineage, decide_deletions, check_incorporation, select_cases, promotion_status, template_report, template_tokens, resolve_template_tokens)
}
SQL = {
    "validate_inventory": _INVENTORY_SQL,
    "inventory_delta": _DELTA_SQL,
    "check_envelope": _ENVELOPE_SQL,
    "run_scorecard": _SCORE_SQL,
    "benchmark_summary": _BENCH_SQL,
    "suite_summary": _SUITE_SQL,
    "score_agreement": _AGREE_SQL,
    "pair_results": _PAIR_SQL,
    "check_references": _REFS_SQL,
    "review_groups": _REVIEW_SQL,
    "is_rfc3339": "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events",
    "plan_templates": _TEMPLATES_SQL,
    "resolve_attributes": _ATTRIBUTES_SQL,
    "check_delta": _CHECK_DELTA_SQL,
    "check_lineage": _LINEAGE_SQL,
    "decide_deletions": _DELETIONS_SQL,
    "check_incorporation": _INCORPORATION_SQL,
    "select_cases": _SELECT_SQL,
    "promotion_status": _PROMOTION_SQL,
    "template_report": _REPORT_SQL,
    "template_tokens": _TOKENS_SQL,
    "resolve_template_tokens": _RESOLVE_SQL,
}
