"""Observations against their context, and scorecards: worked answers and brute force."""

from __future__ import annotations

import json

from ownerloom.operators import ingest, reports

SCOPE = {"workspace_id": "w", "source_id": "s", "document_id": "d", "enumeration": "document-chunks"}
PAYLOAD = {
    "producer": {"id": "p", "version": "1", "contract_ref": "c"}, "scope": SCOPE, "observation_id": "o", "revision_ref": "r", "source_revision_ref": None, "expected_prior_revision_ref": None, "extensions": {"a:b": 1},
    "times": {"source_at": None, "observed_at": "2024-02-29T00:00:00Z"}, "scan": {"status": "complete", "enumerated_scope": SCOPE, "checkpoint_ref": None, "finalization_ref": "f"}, "evidence_refs": ["e", "f"],
}
CONTRACT = {"owner": "o", "model_ref": "m", "model_revision": None, "dimensions": 3, "normalization": "l2", "instruction_profile": None}
SCAN = PAYLOAD["scan"]
CHANGES = [
    ({}, None), ({"producer": None}, "producer"), ({"producer": {"id": "p", "version": 1, "contract_ref": "c"}}, "producer"), ({"producer": {"id": "q", "version": "1", "contract_ref": "c"}}, "scope"), ({"scope": []}, "scope"),
    ({"producer": {"id": ""}, "scope": "s"}, "scope"), ({"scope": SCOPE | {"extra": 1}}, "scope"), ({"scope": SCOPE | {"enumeration": "rows"}}, "scope"), ({"observation_id": ""}, "identity"), ({"revision_ref": None}, "identity"),
    ({"source_revision_ref": ""}, "identity"), ({"source_revision_ref": 1}, None), ({"extensions": {"a": 1}}, "fields"), ({"extensions": None}, "fields"), ({"extensions": {}}, None), ({"times": {"observed_at": None}}, "time"),
    ({"times": []}, "time"), ({"times": {}}, None), ({"times": {"observed_at": "2023-02-29T00:00:00Z"}}, "time"), ({"scan": None}, "scan"), ({"scan": SCAN | {"status": "done"}}, "scan"), ({"scan": SCAN | {"enumerated_scope": {}}}, "scope"),
    ({"scan": SCAN | {"finalization_ref": None}}, "evidence"), ({"scan": SCAN | {"finalization_ref": "g"}}, "evidence"), ({"scan": SCAN | {"status": "partial"}}, "scan"), ({"scan": SCAN | {"status": "partial", "finalization_ref": None}}, None),
    ({"scan": SCAN | {"checkpoint_ref": "g"}}, "evidence"), ({"scan": SCAN | {"checkpoint_ref": "e"}}, None), ({"evidence_refs": None}, "evidence"), ({"evidence_refs": []}, None), ({"evidence_refs": ["e", "x"]}, "evidence"),
    ({"evidence_refs": ["e", None]}, "evidence"), ({"evidence_refs": [1]}, "evidence"), ({"evidence_refs": [""]}, "evidence"), ({"embedding_contract": CONTRACT}, None), ({"embedding_contract": None}, "embedding"),
    ({"embedding_contract": CONTRACT | {"dimensions": 0}}, "embedding"), ({"embedding_contract": CONTRACT | {"dimensions": 1.5}}, "embedding"), ({"embedding_contract": CONTRACT | {"dimensions": None}}, None), ({"embedding_contract": CONTRACT | {"normalization": ""}}, "embedding"),
    ({"embedding_contract": CONTRACT | {"more": 1}}, "embedding"), ({"embedding_contract": CONTRACT | {"owner": None}, "producer": None}, "embedding"),
]
SCHEMA = "observation_key string, context_id string, payload_json string"


def contexts(spark):
    told = [("c", "p", json.dumps(dict(reversed(SCOPE.items())))), ("c", "p", json.dumps(SCOPE)), ("two", "p", json.dumps(SCOPE)), ("two", "q", json.dumps(SCOPE))]
    return spark.createDataFrame(told, "context_id string, producer_id string, scope_json string"), spark.createDataFrame([("c", "e"), ("c", "e"), ("c", "f"), ("two", "g"), (None, "x")], "context_id string, evidence_ref string")


def test_context_codes(spark):
    rows = [(str(k), "c", json.dumps(PAYLOAD | change)) for k, (change, _) in enumerate(CHANGES)]
    got = {r["observation_key"]: r["code"] for r in ingest.check_context(spark.createDataFrame(rows, SCHEMA), *contexts(spark)).collect()}
    assert got == {str(k): code for k, (_, code) in enumerate(CHANGES)}


def test_context_odd_rows(spark):
    """Null keys, repeated rows, unknown and contradictory contexts, no payload; an empty table."""
    good, bad = json.dumps(PAYLOAD), json.dumps(PAYLOAD | {"evidence_refs": ["x"]})
    rows = spark.createDataFrame([(None, "c", good), (None, "c", good), (None, "c", bad), ("a", None, good), ("b", "none", good), ("d", "two", good), ("e", "c", None), ("f", "c", "[")], SCHEMA)
    got = sorted((r["observation_key"] or "", r["code"] or "") for r in ingest.check_context(rows, *contexts(spark)).collect())
    assert got == [("", ""), ("", ""), ("", "evidence"), ("a", "scope"), ("b", "scope"), ("d", "scope"), ("e", "producer"), ("f", "producer")]
    assert ingest.check_context(rows.limit(0), *contexts(spark)).count() == 0


def benchmark(spark, **rows):
    schemas = {
        "cases": "case_id string, operation string, parent_case_id string, run_id int", "runs": "run_id string", "adapters": "run_id string, adapter_id string", "selections": "run_id string, case_id string, side string",
        "results": "run_id string, result_id string, case_id string, adapter_id string, n int", "reported": "run_id string, result_id string",
    }
    given = {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in schemas.items()}
    return sorted((r["run_id"] or "", r["id"] or "", r["violation"], r["n"]) for r in reports.check_benchmark(**given).collect())


def test_benchmark_references(spark):
    """Each violation alone, null references, repeated rows, tables with further columns of clashing names; sound and empty tables."""
    sound = {
        "cases": [("a", "merge", None, 1), ("b", "metamorphic", "a", 1)], "runs": [("r",)], "adapters": [("r", "x")], "selections": [("r", "a", "selected"), ("r", "b", "excluded")],
        "results": [("r", "1", "a", "x", 5)], "reported": [("r", "1")],
    }
    assert benchmark(spark) == []
    assert benchmark(spark, **sound) == []
    faulty = {
        "cases": sound["cases"] + [("c", "metamorphic", None, 1), ("d", "metamorphic", "z", 1)], "runs": sound["runs"], "adapters": sound["adapters"],
        "selections": sound["selections"] + [("r", "a", "selected"), ("r", "a", "excluded"), ("r", "z", "selected"), ("r", None, "excluded"), ("q", "b", "excluded"), ("q", "b", "excluded")],
        "results": sound["results"] * 2 + [("r", "2", "a", "y", 5), ("s", "3", "z", "x", 5), ("r", "4", None, None, 5)], "reported": sound["reported"] + [("r", "2"), ("r", "2"), ("r", "9"), ("s", "3")],
    }
    assert benchmark(spark, **faulty) == sorted([
        ("", "c", "dangling_parent", 1), ("", "d", "dangling_parent", 1), ("r", "a", "duplicate_selected", 2), ("r", "a", "overlap", 3), ("q", "b", "duplicate_excluded", 2), ("r", "z", "dangling_selection", 1),
        ("r", "", "dangling_selection", 1), ("s", "", "dangling_run", 1), ("s", "x", "dangling_adapter", 1), ("r", "y", "dangling_adapter", 1), ("r", "", "dangling_adapter", 1), ("s", "z", "dangling_result_case", 1),
        ("r", "", "dangling_result_case", 1), ("r", "1", "duplicate_result", 2), ("r", "2", "duplicate_reported", 2), ("r", "4", "unreported", 1), ("r", "9", "unknown_reported", 1),
    ])


def test_scorecard_percentiles_are_exact(spark):
    """Values whose ranks a sketch can miss by a row: 50 % of them lie in the lower half to the row, and 95 % below the last step."""
    n = 200_000
    rows = spark.range(n).selectExpr("'e' AS extension", "concat('r', id % 2) AS repository", "'completed' AS status", f"CASE WHEN id < {n // 2} THEN 1D ELSE id + 0D END AS seconds", "false AS markers", "true AS exact")
    rows = rows.unionByName(spark.sql("SELECT 'e' AS extension, 'r2' AS repository, 'failed' AS status, cast(null AS double) AS seconds, false AS markers, false AS exact"))
    got = {(r["dimension"], r["value"]): (r["cases"], r["p50"], r["p95"]) for r in reports.run_scorecard(rows.repartition(8)).collect()}
    p95 = float(n * 95 // 100 - 1)
    assert got == {("all", "all"): (n + 1, 1.0, p95), ("extension", "e"): (n + 1, 1.0, p95), ("repository", "r0"): (n // 2, 1.0, p95 - 1), ("repository", "r1"): (n // 2, 1.0, p95), ("repository", "r2"): (1, None, None)}
