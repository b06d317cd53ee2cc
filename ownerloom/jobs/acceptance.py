"""Queries over observations and the contexts that receive them, over the tables of benchmark runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.jobs.demo_data import table
from ownerloom.operators import ingest, reports

#: A payload of event e of user u, in SQL that Spark and DuckDB both run; each part is wrong for some numbers.
_SCOPE = """concat('{"workspace_id":"w', u % 3, '","source_id":"s","document_id":"d', u, '","enumeration":"document-chunks"}')"""
_PAYLOAD = f"""concat('{{"observation_id":"', CASE WHEN e % 31 = 0 THEN '' ELSE concat('o', e) END, '","revision_ref":"r', e, '","expected_prior_revision_ref":', CASE WHEN e % 37 = 0 THEN '""' ELSE 'null' END,
  ',"producer":', CASE WHEN e % 41 = 0 THEN '"p"' WHEN e % 43 = 0 THEN '{{"id":"p","version":"","contract_ref":"c"}}' WHEN e % 47 = 0 THEN '{{"id":"q","version":"1","contract_ref":"c"}}' ELSE '{{"id":"p","version":"1","contract_ref":"c"}}' END,
  ',"scope":', CASE WHEN e % 53 = 0 THEN '[]' WHEN e % 59 = 0 THEN replace({_SCOPE}, 'document-chunks', 'rows') WHEN e % 61 = 0 THEN replace({_SCOPE}, '"s"', '"z"') ELSE {_SCOPE} END,
  ',"extensions":', CASE WHEN e % 67 = 0 THEN '{{"a":1}}' WHEN e % 71 = 0 THEN 'null' WHEN e % 2 = 0 THEN '{{"a:b":1}}' ELSE '{{}}' END,
  ',"times":{{"source_at":null,"observed_at":"', CASE WHEN e % 29 = 0 THEN '2024-02-30T00:00:00Z' ELSE '2024-02-28T00:00:00Z' END, '"}}',
  ',"scan":{{"status":"', CASE WHEN e % 23 = 0 THEN 'done' WHEN e % 3 = 0 THEN 'partial' ELSE 'complete' END, '","enumerated_scope":', CASE WHEN e % 19 = 0 THEN '{{}}' WHEN e % 53 = 0 THEN '[]' WHEN e % 59 = 0 THEN replace({_SCOPE}, 'document-chunks', 'rows') ELSE {_SCOPE} END,
  ',"finalization_ref":', CASE WHEN e % 17 = 0 THEN 'null' WHEN e % 3 = 0 AND e % 13 <> 0 THEN 'null' ELSE concat('"f', e % 11, '"') END, ',"checkpoint_ref":', CASE WHEN e % 7 = 0 THEN '"k"' ELSE 'null' END, '}}',
  ',"evidence_refs":', CASE WHEN e % 73 = 0 THEN '{{}}' WHEN e % 79 = 0 THEN '[1]' WHEN e % 5 = 0 THEN concat('["e', e % 4, '","e0"]') ELSE '[]' END,
  CASE WHEN e % 83 = 0 THEN ',"embedding_contract":{{"owner":"o"}}' WHEN e % 6 = 1 THEN concat(',"embedding_contract":{{"owner":"o","model_ref":"m","model_revision":null,"normalization":"', CASE WHEN e % 89 = 0 THEN '' ELSE 'l2' END, '","instruction_profile":null,"dimensions":', e % 25, '}}') ELSE '' END, '}}')"""
#: Contexts of users but for some, and their evidence: pieces of evidence that some users lack.
_CONTEXTS = f"SELECT DISTINCT u AS context_id, 'p' AS producer_id, {_SCOPE} AS scope_json FROM ev WHERE u % 97 <> 5"
_EVIDENCE = "SELECT DISTINCT u AS context_id, concat('f', e % 11) AS evidence_ref FROM ev WHERE (u + e) % 11 <> 3 UNION ALL SELECT DISTINCT u, concat('e', e % 4) FROM ev WHERE u % 9 <> 0 UNION ALL SELECT DISTINCT u, 'k' FROM ev WHERE u % 13 <> 0"


def check_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"))
    run = lambda sql: spark.sql(sql.replace("FROM ev", "FROM {ev}"), ev=ev)
    observations = ev.select(F.col("e").alias("observation_key"), F.col("u").alias("context_id"), F.expr(_PAYLOAD).alias("payload_json"))
    return ingest.check_context(observations, run(_CONTEXTS.replace("{", "{{").replace("}", "}}")), run(_EVIDENCE))


#: The SQL reads the payloads with JSON functions, as the operator does; it doesn't repeat the rule by which they are made.
_T = "CASE WHEN json_type(j, '$.{0}') = 'VARCHAR' THEN json_extract_string(j, '$.{0}') END"
_NAMED = lambda path: f"coalesce(({_T.format(path)}) <> '', false)"
_NONE_OR_NAMED = lambda path: f"(coalesce(json_type(j, '$.{path}') = 'NULL', false) OR {_NAMED(path)})"
_MEMBERS = "['workspace_id', 'source_id', 'document_id', 'enumeration']"
_SAME = lambda a, b: f"coalesce(list_sort(json_keys({a})) = list_sort(json_keys({b})) AND list_transform({_MEMBERS}, lambda m: coalesce(json_extract({a}, '$.' || m)::VARCHAR, '')) = list_transform({_MEMBERS}, lambda m: coalesce(json_extract({b}, '$.' || m)::VARCHAR, '')), {a}::VARCHAR = {b}::VARCHAR, false)"
_CONTEXT_SQL = f"""WITH ev AS (SELECT event_id AS e, user_id AS u FROM events), c AS ({_CONTEXTS}), n AS (SELECT context_id, list(DISTINCT evidence_ref) AS known FROM ({_EVIDENCE}) GROUP BY 1),
o AS (SELECT e, u, ({_PAYLOAD})::JSON AS j FROM ev),
p AS (SELECT o.*, c.producer_id, c.scope_json::JSON AS told, coalesce(n.known, []) AS known, json_extract(j, '$.scope') AS sc, json_extract(j, '$.scan.enumerated_scope') AS es, {_T.format("scan.status")} AS status, {_T.format("scan.finalization_ref")} AS fin, {_T.format("scan.checkpoint_ref")} AS cp,
  json_extract(j, '$.evidence_refs[*]') AS refs FROM o LEFT JOIN c ON c.context_id = o.u LEFT JOIN n ON n.context_id = o.u)
SELECT e AS observation_key, u AS context_id, CASE
  WHEN json_type(j, '$.embedding_contract') IS NOT NULL AND NOT coalesce(json_type(j, '$.embedding_contract') = 'OBJECT' AND list_sort(json_keys(j, '$.embedding_contract')) = ['dimensions', 'instruction_profile', 'model_ref', 'model_revision', 'normalization', 'owner'] AND {_NAMED("embedding_contract.owner")} AND {_NAMED("embedding_contract.model_ref")}
    AND {_NONE_OR_NAMED("embedding_contract.model_revision")} AND {_NONE_OR_NAMED("embedding_contract.normalization")} AND {_NONE_OR_NAMED("embedding_contract.instruction_profile")} AND (json_type(j, '$.embedding_contract.dimensions') = 'NULL' OR (json_type(j, '$.embedding_contract.dimensions') = 'UBIGINT' AND json_extract(j, '$.embedding_contract.dimensions')::BIGINT > 0)), false) THEN 'embedding'
  WHEN NOT coalesce(json_type(j, '$.producer') = 'OBJECT', false) THEN 'producer' WHEN NOT coalesce(json_type(sc) = 'OBJECT', false) THEN 'scope' WHEN NOT ({_NAMED("producer.id")} AND {_NAMED("producer.version")} AND {_NAMED("producer.contract_ref")}) THEN 'producer'
  WHEN NOT ({_NAMED("scope.workspace_id")} AND {_NAMED("scope.source_id")} AND {_NAMED("scope.document_id")} AND json_extract_string(sc, '$.enumeration') = 'document-chunks') THEN 'scope'
  WHEN told IS NULL OR json_extract_string(j, '$.producer.id') <> producer_id OR NOT {_SAME("sc", "told")} THEN 'scope'
  WHEN NOT ({_NAMED("observation_id")} AND {_NAMED("revision_ref")}) OR json_extract_string(j, '$.source_revision_ref') = '' OR json_extract_string(j, '$.expected_prior_revision_ref') = '' THEN 'identity'
  WHEN NOT coalesce(json_type(j, '$.extensions') = 'OBJECT', false) OR len(list_filter(json_keys(j, '$.extensions'), lambda x: NOT contains(x, ':'))) > 0 THEN 'fields'
  WHEN try_strptime(json_extract_string(j, '$.times.observed_at'), '%Y-%m-%dT%H:%M:%SZ') IS NULL THEN 'time'
  WHEN NOT coalesce(status IN ('complete', 'partial', 'interrupted', 'unknown'), false) THEN 'scan' WHEN NOT {_SAME("es", "sc")} THEN 'scope'
  WHEN status = 'complete' AND (fin IS NULL OR NOT list_contains(known, fin)) THEN 'evidence' WHEN status <> 'complete' AND fin IS NOT NULL THEN 'scan' WHEN cp IS NOT NULL AND NOT list_contains(known, cp) THEN 'evidence'
  WHEN NOT coalesce(json_type(j, '$.evidence_refs') = 'ARRAY', false) OR len(list_filter(refs, lambda r: json_type(r) <> 'VARCHAR' OR r ->> '$' = '' OR NOT list_contains(known, r ->> '$'))) > 0 THEN 'evidence' END AS code FROM p"""

#: Benchmark tables of orders and line items, in SQL that Spark and DuckDB both run.
_BENCHMARK = {
    "cases": "SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 'metamorphic' ELSE 'merge' END AS operation, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - 1 END AS parent_case_id FROM orders WHERE o_orderkey % 9 <> 1",
    "runs": "SELECT DISTINCT p_partkey % 4 AS run_id FROM part",
    "adapters": "SELECT DISTINCT p_partkey % 4 AS run_id, p_partkey % 12 AS adapter_id FROM part",
    "selections": "SELECT l_suppkey % 4 AS run_id, l_orderkey AS case_id, CASE WHEN l_linenumber % 5 = 0 THEN 'excluded' ELSE 'selected' END AS side FROM lineitem",
    "results": "SELECT l_suppkey % 5 AS run_id, l_orderkey * 10 + l_linenumber % 6 AS result_id, l_orderkey AS case_id, l_partkey % 12 AS adapter_id FROM lineitem WHERE l_orderkey % 8 <> 0",
    "reported": "SELECT l_suppkey % 5 AS run_id, l_orderkey * 10 + l_linenumber % 6 AS result_id FROM lineitem WHERE l_partkey % 11 <> 0",
}


def check_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {name: table(spark, sf_dir, name) for name in ("orders", "part", "lineitem")}

    def run(sql: str) -> DataFrame:
        name = sql.split("FROM ")[1].split()[0]
        return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: given[name]})

    return reports.check_benchmark(*[run(sql) for sql in _BENCHMARK.values()])


_BENCHMARK_SQL = f"""WITH {", ".join(f"{name} AS ({sql})" for name, sql in _BENCHMARK.items())},
v AS (SELECT NULL AS run_id, case_id AS id, 'dangling_parent' AS violation, count(*) AS n FROM cases WHERE operation = 'metamorphic' AND (parent_case_id IS NULL OR parent_case_id NOT IN (SELECT case_id FROM cases)) GROUP BY case_id
UNION ALL SELECT run_id, case_id, 'duplicate_' || side, count(*) FROM selections GROUP BY run_id, case_id, side HAVING count(*) > 1
UNION ALL SELECT run_id, case_id, 'overlap', count(*) FROM selections GROUP BY run_id, case_id HAVING count(DISTINCT side) = 2
UNION ALL SELECT run_id, case_id, 'dangling_selection', count(*) FROM selections WHERE case_id NOT IN (SELECT case_id FROM cases) GROUP BY run_id, case_id
UNION ALL SELECT run_id, NULL, 'dangling_run', count(*) FROM results WHERE run_id NOT IN (SELECT run_id FROM runs) GROUP BY run_id
UNION ALL SELECT run_id, adapter_id, 'dangling_adapter', count(*) FROM results WHERE (run_id, adapter_id) NOT IN (SELECT (run_id, adapter_id) FROM adapters) GROUP BY run_id, adapter_id
UNION ALL SELECT run_id, case_id, 'dangling_result_case', count(*) FROM results WHERE case_id NOT IN (SELECT case_id FROM cases) GROUP BY run_id, case_id
UNION ALL SELECT run_id, result_id, 'duplicate_result', count(*) FROM results GROUP BY run_id, result_id HAVING count(*) > 1
UNION ALL SELECT run_id, result_id, 'duplicate_reported', count(*) FROM reported GROUP BY run_id, result_id HAVING count(*) > 1
UNION ALL SELECT run_id, result_id, 'unreported', count(*) FROM results ANTI JOIN reported USING (run_id, result_id) GROUP BY run_id, result_id
UNION ALL SELECT run_id, result_id, 'unknown_reported', count(*) FROM reported ANTI JOIN results USING (run_id, result_id) GROUP BY run_id, result_id)
SELECT run_id::VARCHAR AS run_id, id::VARCHAR AS id, violation, n FROM v"""

QUERIES = {"check_context": check_context, "check_benchmark": check_benchmark}
SQL = {"check_context": _CONTEXT_SQL, "check_benchmark": _BENCHMARK_SQL}
