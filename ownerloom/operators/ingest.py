"""Chunk inventories and observations of them: validation, deltas, lineage, deletions, acceptance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.functions.scalars import is_rfc3339_utc

SCOPE = ("producer_id", "scope")


def validate_inventory(chunks: DataFrame) -> DataFrame:
    """chunks (producer_id, scope, revision_ref, chunk_id, ordinal, content_hash) -> violations of a revision:
    empty_field, duplicate_id, duplicate_ordinal, each with the number of rows. Partial counts, no lists."""
    revision = (*SCOPE, "revision_ref")
    empty = chunks.where((F.coalesce("chunk_id", F.lit("")) == "") | (F.coalesce("content_hash", F.lit("")) == "") | F.col("ordinal").isNull())
    told = lambda df, name: df.groupBy(*revision).agg(F.count("*").alias("n")).withColumn("violation", F.lit(name))
    twice = lambda c: chunks.groupBy(*revision, c).agg(F.count("*").alias("k")).where("k > 1")
    return told(empty, "empty_field").unionByName(told(twice("chunk_id"), "duplicate_id")).unionByName(told(twice("ordinal"), "duplicate_ordinal"))


def inventory_delta(prior: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("scope", "chunk_id")) -> DataFrame:
    """keys and change (added, updated, removed) between two inventories, by id and content hash."""
    side = lambda df, n: df.select(*keys, F.col("content_hash").alias(n))
    both = side(prior, "before").join(side(current, "after"), list(keys), "full_outer")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "updated")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


def check_delta(declared: DataFrame, derived: DataFrame, keys: tuple[str, ...] = ("scope", "chunk_id")) -> DataFrame:
    """declared (keys, change) rows that the inventories do not bear out, with a code."""
    true = derived.select(*keys, F.col("change").alias("derived"))
    rows = declared.join(true, list(keys), "left")
    code = F.when(F.col("derived").isNull(), "unchanged_or_unknown").when(F.col("derived") != F.col("change"), "wrong_change")
    return rows.withColumn("code", code).where("code IS NOT NULL").select(*keys, "change", "code")


#: Fields of an observation's payload (fixed values).
REQUIRED_FIELDS = (
    "producer", "scope", "observation_id", "revision_ref", "source_revision_ref", "expected_prior_revision_ref", "prior_inventory", "current_inventory", "added", "updated",
    "removed", "original", "normalized", "processing", "times", "scan", "deletion", "evidence_refs", "extensions",
)
OPTIONAL_FIELDS = ("revision_parents", "source_time_start", "source_time_end", "embedding_contract", "lineage", "incorporation")


def check_envelope(observations: DataFrame, schema: str, required: tuple[str, ...] = REQUIRED_FIELDS, optional: tuple[str, ...] = OPTIONAL_FIELDS) -> DataFrame:
    """observations (observation_key, schema, payload_json, payload_digest) -> observation_key, code: the first fault in the order
    schema, payload_digest, json (no JSON, or a name stands twice), time (one end of the source time only), fields (unknown,
    missing, or no object), ancestry, time (an end is no UTC instant, or they are turned around); null if all holds.

    Parents are distinct, not empty and not the revision itself. A first revision (no parents) expects no prior one; else an
    expected prior revision is the revision itself or one of its parents. Columns of one row only; no shuffle."""
    v = F.try_parse_json("payload_json")
    rows = observations.withColumn("v", v).withColumn("is_object", F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False)))
    rows = rows.withColumn("names", F.when(F.col("is_object"), F.expr("map_keys(cast(v AS map<string,variant>))")))
    text = lambda c: F.when(F.expr(f"schema_of_variant(variant_get(v, '$.{c}', 'variant'))") == "STRING", F.expr(f"try_variant_get(v, '$.{c}', 'string')"))
    parents = F.expr("try_variant_get(v, '$.revision_parents', 'array<string>')")
    kind = F.expr("schema_of_variant(variant_get(v, '$.revision_parents', 'variant'))")
    rows = rows.withColumns({"parents": parents, "kind": kind, "revision": text("revision_ref"), "expected": text("expected_prior_revision_ref"), "begins": text("source_time_start"), "ends": text("source_time_end")})
    has = lambda c: F.array_contains("names", c)
    known = F.array(*[F.lit(c) for c in (*required, *optional)])
    odd_parents = ~F.coalesce(F.col("kind").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) | F.exists("parents", lambda p: (p == "") | p.eqNullSafe(F.col("revision"))) | (F.size(F.array_distinct("parents")) < F.size("parents")) | F.col("revision").isNull()
    broken = F.when(F.size("parents") == 0, F.col("expected").isNotNull()).otherwise(F.col("expected").isNotNull() & (F.col("expected") != F.col("revision")) & ~F.array_contains("parents", F.col("expected")))
    code = (
        F.when(~F.col("schema").eqNullSafe(F.lit(schema)), "schema").when(~F.sha2(F.encode("payload_json", "utf-8"), 256).eqNullSafe(F.col("payload_digest")), "payload_digest").when(F.col("v").isNull(), "json")
        .when(~F.col("is_object"), "fields").when(has("source_time_start") != has("source_time_end"), "time").when(F.size(F.array_except("names", known)) > 0, "fields")
        .when(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "names")) > 0, "fields").when(has("revision_parents") & F.coalesce(odd_parents | broken, F.lit(True)), "ancestry")
        .when(has("source_time_start") & ~F.coalesce(is_rfc3339_utc(F.col("begins")) & is_rfc3339_utc(F.col("ends")) & (F.col("begins") <= F.col("ends")), F.lit(False)), "time")
    )
    return rows.select("observation_key", code.alias("code"))


#: What an embedding contract consists of, the enumeration of a scope, what a scan may say of itself.
EMBEDDING_FIELDS = ("owner", "model_ref", "model_revision", "dimensions", "normalization", "instruction_profile")
ENUMERATION = "document-chunks"
SCAN_STATUS = ("complete", "partial", "interrupted", "unknown")
#: Members of a payload that check_context() reads.
MEMBERS = (
    "producer", "producer.id", "producer.version", "producer.contract_ref", "scope", "scope.workspace_id", "scope.source_id", "scope.document_id", "scope.enumeration", "observation_id", "revision_ref", "source_revision_ref",
    "expected_prior_revision_ref", "extensions", "times", "scan.status", "scan.enumerated_scope", "scan.finalization_ref", "scan.checkpoint_ref", "evidence_refs", "embedding_contract", *(f"embedding_contract.{c}" for c in EMBEDDING_FIELDS),
)


def check_context(observations: DataFrame, contexts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Payloads against the context that receives them -> observation_key, context_id, code: the first fault in the order embedding, producer,
    scope, identity, fields (extensions), time (of processing), scan, scope (enumerated), evidence or scan (finalization), evidence; null
    if all holds.

    observations: observation_key, context_id, payload_json, which check_envelope() has passed. contexts: context_id, producer_id, scope_json; an
    observation of an unknown context has the code scope, of a context that stands twice with other values as well. evidence: context_id,
    evidence_ref. An embedding contract is optional; a scope has exactly the context's members. A complete scan needs a finalization that is
    evidence there, any other has none. Null, missing and wrongly typed members are faults of their part.

    Fields are cut from the payload in place. What is shuffled are references, one row each, against the evidence, and narrow rows;
    repeated observations that are equal share one answer."""
    at, kind, text = (lambda path, of=of: F.col(f"{of}_{path.replace('.', '_')}") for of in ("at", "kind", "text"))
    is_object = lambda path: F.coalesce(F.startswith(kind(path), F.lit("OBJECT")), F.lit(False))
    names = lambda path: F.map_keys(F.expr(f"try_variant_get(v, '$.{path}', 'map<string,variant>')"))
    named = lambda path: F.coalesce(text(path) != "", F.lit(False))
    none_or_named = lambda path: F.coalesce(kind(path) == "VOID", F.lit(False)) | named(path)
    every = lambda test, paths: F.forall(F.array(*[test(p) for p in paths]), lambda x: x)

    key = F.sha2(F.to_json(F.struct("observation_key", "context_id", "payload_json")), 256)
    rows = observations.select("observation_key", "context_id", "payload_json").withColumn("k", key).withColumn("v", F.try_parse_json("payload_json"))
    # Each member is cut, typed and read once, as a column of its own.
    column = lambda of, path: f"{of}_{path.replace('.', '_')}"
    rows = rows.withColumns({column("at", p): F.expr(f"variant_get(v, '$.{p}', 'variant')") for p in MEMBERS}).withColumns({column("kind", p): F.schema_of_variant(at(p)) for p in MEMBERS})
    rows = rows.withColumns({column("text", p): F.when(kind(p) == "STRING", F.expr(f"try_variant_get({column('at', p)}, '$', 'string')")) for p in MEMBERS})
    exact = is_object("embedding_contract") & (F.size(names("embedding_contract")) == len(EMBEDDING_FIELDS)) & (F.size(F.array_intersect(names("embedding_contract"), F.array(*[F.lit(c) for c in EMBEDDING_FIELDS]))) == len(EMBEDDING_FIELDS))
    whole = F.coalesce((kind("embedding_contract.dimensions") == "BIGINT") & (F.expr("try_variant_get(v, '$.embedding_contract.dimensions', 'bigint')") > 0), F.lit(False))
    embedding = exact & every(named, ("embedding_contract.owner", "embedding_contract.model_ref")) & every(none_or_named, [f"embedding_contract.{c}" for c in ("model_revision", "normalization", "instruction_profile")]) & (F.coalesce(kind("embedding_contract.dimensions") == "VOID", F.lit(False)) | whole)
    times = F.expr("try_variant_get(v, '$.times', 'map<string,string>')")
    odd_time = F.exists(F.map_entries(times), lambda e: ~((e["key"] == "source_at") & e["value"].isNull()) & ~F.coalesce(is_rfc3339_utc(e["value"]), F.lit(False)))
    refs = F.expr("try_variant_get(v, '$.evidence_refs', 'array<string>')")
    refs_are_texts = F.coalesce(kind("evidence_refs").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False)) & ~F.exists(refs, lambda r: r.isNull() | (r == ""))
    status, finalization, checkpoint = text("scan.status"), text("scan.finalization_ref"), text("scan.checkpoint_ref")
    own = F.when(at("embedding_contract").isNotNull() & ~F.coalesce(embedding, F.lit(False)), "embedding").when(~is_object("producer"), "producer").when(~is_object("scope"), "scope").when(~every(named, [f"producer.{c}" for c in ("id", "version", "contract_ref")]), "producer").when(~every(named, [f"scope.{c}" for c in ("workspace_id", "source_id", "document_id", "enumeration")]) | (text("scope.enumeration") != ENUMERATION), "scope")
    later = (
        F.when(~named("observation_id") | ~named("revision_ref") | F.coalesce(text("source_revision_ref") == "", F.lit(False)) | F.coalesce(text("expected_prior_revision_ref") == "", F.lit(False)), "identity")
        .when(~is_object("extensions") | F.exists(names("extensions"), lambda n: ~F.contains(n, F.lit(":"))), "fields").when(~is_object("times") | F.coalesce(odd_time, F.lit(False)), "time")
        .when(~F.coalesce(status.isin(*SCAN_STATUS), F.lit(False)), "scan").when(~F.to_json(at("scan.enumerated_scope")).eqNullSafe(F.to_json(at("scope"))), "scope")
        .when((status == "complete") & finalization.isNull(), "evidence").when((status != "complete") & finalization.isNotNull(), "scan").when(~refs_are_texts, "evidence")
    )
    narrow = rows.select("observation_key", "context_id", "k", F.coalesce(own, F.lit("")).alias("own"), F.coalesce(later, F.lit("")).alias("later"), text("producer.id").alias("p"), F.to_json(at("scope")).alias("s"), F.array_compact(F.array_append(F.array_append(F.coalesce(refs, F.array().cast("array<string>")), finalization), checkpoint)).alias("refs"))

    there = evidence.select("context_id", "evidence_ref").distinct().withColumn("there", F.lit(True))
    # explode_outer: a filter on the references would be pushed below the parsed payload and parse it for each of its uses.
    given = narrow.select("k", "context_id", F.explode_outer(F.array_distinct("refs")).alias("evidence_ref"))
    unknown = given.where("evidence_ref IS NOT NULL").join(there, ["context_id", "evidence_ref"], "left").where("there IS NULL").select("k").distinct().withColumn("unknown", F.lit(True))
    told = contexts.select("context_id", "producer_id", F.to_json(F.try_parse_json("scope_json")).alias("told")).groupBy("context_id").agg(F.min("producer_id").alias("lo"), F.max("producer_id").alias("hi"), F.min("told").alias("told"), F.max("told").alias("told_hi"))
    out = narrow.join(told, "context_id", "left").join(unknown, "k", "left")
    fits = (F.col("lo") == F.col("hi")) & (F.col("told") == F.col("told_hi")) & (F.col("lo") == F.col("p")) & (F.col("told") == F.col("s"))
    code = F.when(F.col("own") != "", F.col("own")).when(~F.coalesce(fits, F.lit(False)), "scope").when(F.col("later") != "", F.col("later")).when(F.col("unknown"), "evidence")
    return out.select("observation_key", "context_id", code.alias("code"))


#: What an assertion of lineage may say of itself.
LINEAGE_KINDS = ("move", "copy", "split", "join", "reorder")
LINEAGE_STATUS = ("asserted", "ambiguous", "unknown")


def check_lineage(assertions: DataFrame, prior: DataFrame, current: DataFrame) -> DataFrame:
    """assertions -> scope, assertion_id, code: the first fault of kind, status, reference, provenance, confidence, empty_side, unknown_prior,
    unknown_current, reorder_changes_content; null if all holds.

    assertions: scope, assertion_id, kind, status, prior_refs and current_refs (arrays of chunk_id, ordinal), basis, authority_ref, algorithm_id,
    algorithm_version, confidence. An authored assertion names an authority and no algorithm, an algorithmic one an algorithm and its version and no authority,
    an unknown one neither; a confidence may be missing. Only what is asserted is held to the inventories (scope, chunk_id, ordinal,
    content_hash): both sides name occurrences that stand there, and a reorder keeps the multiset of hashes."""
    rows = assertions.withColumn("n", F.row_number().over(Window.partitionBy("scope", "assertion_id").orderBy("kind", "status")))
    key = ["scope", "assertion_id", "n"]

    def met(refs: str, inventory: DataFrame, name: str) -> DataFrame:
        """Of each assertion: whether a reference is unknown, and the hashes of those that are known."""
        given = rows.where("status = 'asserted'").select(*key, F.explode(refs).alias("ref")).select(*key, "ref.chunk_id", "ref.ordinal")
        there = inventory.select("scope", "chunk_id", "ordinal", "content_hash").dropDuplicates(["scope", "chunk_id", "ordinal"]).withColumn("there", F.lit(True))
        found = given.join(there, ["scope", "chunk_id", "ordinal"], "left").groupBy(*key)
        return found.agg(F.bool_or(F.col("there").isNull()).alias(f"{name}_unknown"), F.sort_array(F.collect_list("content_hash")).alias(f"{name}_hashes"))

    rows = rows.join(met("prior_refs", prior, "prior"), key, "left").join(met("current_refs", current, "current"), key, "left")
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    odd = lambda refs: F.col(refs).isNull() | F.exists(refs, lambda r: r.isNull() | (F.coalesce(r.chunk_id, F.lit("")) == "") | r.ordinal.isNull() | (r.ordinal < 0))
    no_algorithm = F.col("algorithm_id").isNull() & F.col("algorithm_version").isNull()
    sound = (
        F.when(F.col("basis") == "authored", named("authority_ref") & no_algorithm).when(F.col("basis") == "algorithmic", F.col("authority_ref").isNull() & named("algorithm_id") & named("algorithm_version"))
        .when(F.col("basis") == "unknown", F.col("authority_ref").isNull() & no_algorithm)
    )
    asserted = F.col("status") == "asserted"
    code = (
        F.when(~F.coalesce(F.col("kind").isin(*LINEAGE_KINDS), F.lit(False)), "kind").when(~F.coalesce(F.col("status").isin(*LINEAGE_STATUS), F.lit(False)), "status").when(odd("prior_refs") | odd("current_refs"), "reference")
        .when(~F.coalesce(sound, F.lit(False)), "provenance").when(F.isnan("confidence") | ~F.col("confidence").between(0, 1), "confidence")
        .when(asserted & ((F.size("prior_refs") == 0) | (F.size("current_refs") == 0)), "empty_side").when(asserted & F.col("prior_unknown"), "unknown_prior").when(asserted & F.col("current_unknown"), "unknown_current")
        .when(asserted & (F.col("kind") == "reorder") & ~F.col("prior_hashes").eqNullSafe(F.col("current_hashes")), "reorder_changes_content")
    )
    return rows.select("scope", "assertion_id", code.alias("code"))


def check_incorporation(records: DataFrame, evidence: DataFrame, prior: DataFrame, current: DataFrame) -> DataFrame:
    """records (scope, decision_id, authority_ref, source_refs and subject_refs (arrays of chunk_id, ordinal), outcome, evidence_refs)
    -> scope, decision_id, code: the first fault of empty_field, duplicate_decision, outcome, unknown_source, unknown_subject,
    no_subject, unknown_evidence; null if all holds.

    evidence: scope, evidence_ref. Sources must stand in the prior inventory, subjects in the current one (scope, chunk_id,
    ordinal). References meet by equi-joins; a record is told apart by a number of its own, so repeated decisions stay apart."""
    rows = records.withColumn("n", F.row_number().over(Window.partitionBy("scope", "decision_id").orderBy("authority_ref", "outcome"))).withColumn("copies", F.count("*").over(Window.partitionBy("scope", "decision_id")))
    key = ["scope", "decision_id", "n"]

    def unknown(refs: str, known: DataFrame, columns: list[str], name: str) -> DataFrame:
        given = rows.select(*key, F.explode(refs).alias("ref"))
        given = given.select(*key, *([F.col(f"ref.{c}").alias(c) for c in columns] if len(columns) > 1 else [F.col("ref").alias(columns[0])]))
        there = known.select("scope", *columns).distinct().withColumn("there", F.lit(True))
        return given.join(there, ["scope", *columns], "left").groupBy(*key).agg(F.bool_or(F.col("there").isNull()).alias(name))

    out = rows
    for found in (unknown("source_refs", prior, ["chunk_id", "ordinal"], "bad_source"), unknown("subject_refs", current, ["chunk_id", "ordinal"], "bad_subject"), unknown("evidence_refs", evidence, ["evidence_ref"], "bad_evidence")):
        left, right = out.alias("l"), found.alias("r")
        same = F.col("l.scope").eqNullSafe(F.col("r.scope")) & F.col("l.decision_id").eqNullSafe(F.col("r.decision_id")) & (F.col("l.n") == F.col("r.n"))
        out = left.join(right, same, "left").select("l.*", f"r.{found.columns[-1]}")
    empty = (F.coalesce("decision_id", F.lit("")) == "") | (F.coalesce("authority_ref", F.lit("")) == "")
    code = (
        F.when(empty, "empty_field").when(F.col("copies") > 1, "duplicate_decision").when(~F.coalesce(F.col("outcome").isin("accepted", "rejected", "edited", "ignored", "unknown"), F.lit(False)), "outcome")
        .when(F.col("bad_source"), "unknown_source").when(F.col("bad_subject"), "unknown_subject").when(F.col("outcome").isin("accepted", "rejected", "edited") & (F.coalesce(F.size("subject_refs"), F.lit(0)) <= 0), "no_subject")
        .when(F.col("bad_evidence"), "unknown_evidence")
    )
    return out.select("scope", "decision_id", code.alias("code"))


OBSERVATION = ("producer_id", "scope", "observation_id")


def decide_deletions(observations: DataFrame, targets: DataFrame, removed: DataFrame, prior: DataFrame, current: DataFrame, authorities: DataFrame, authority_targets: DataFrame) -> DataFrame:
    """Each observation's deletion, decided as a whole: producer_id, scope, observation_id, mode, authority_ref, n_targets, code (deletion,
    authority, null if it holds).

    observations: those keys, mode, authority_ref, status, finalization_ref. targets, removed, prior, current: the keys and chunk_id. authorities:
    authority_ref, producer_id, scope, mode, finalization_ref; authority_targets: authority_ref, chunk_id.

    none has neither authority nor targets. absence needs a complete scan, and its targets are just what was removed, all of it known before.
    explicit_source needs an empty current inventory and targets all that was known. Both need an authority of the same producer, scope, mode and
    finalization with just these targets. Sets are compared by one conditional aggregation over (observation, chunk), those of
    authorities by counts and sums of two hashes; no list is made of a set."""
    key = list(OBSERVATION)
    chunk = F.coalesce(F.col("chunk_id"), F.lit(""))
    part = lambda df, name: df.select(*key, chunk.alias("chunk_id"), F.lit(name).alias("of"))
    rows = part(targets, "targets").unionByName(part(removed, "removed")).unionByName(part(prior, "prior")).unionByName(part(current, "current"))
    sets = ("targets", "removed", "prior", "current")
    each = rows.groupBy(*key, "chunk_id").agg(*[F.bool_or(F.col("of") == s).alias(s) for s in sets])
    hashes = lambda test: [F.count_if(test).alias("n"), *[F.sum(F.when(test, F.xxhash64(F.col("chunk_id"), F.lit(k)).cast("decimal(38,0)"))).alias(f"h{k}") for k in (1, 2)]]
    sums = each.groupBy(*key).agg(
        *hashes(F.col("targets")), F.bool_or(F.col("targets") & (F.col("chunk_id") == "")).alias("unnamed"), F.bool_or(F.col("targets") != F.col("removed")).alias("not_removed"), F.bool_or(F.col("targets") & ~F.col("prior")).alias("not_prior"),
        F.bool_or(F.col("targets") != F.col("prior")).alias("not_all"), F.bool_or("current").alias("has_current"),
    )
    granted = authority_targets.select("authority_ref", chunk.alias("chunk_id")).distinct().groupBy("authority_ref").agg(*hashes(F.lit(True)), F.bool_or(F.col("chunk_id") == "").alias("unnamed"))
    granted = authorities.select("authority_ref", *[F.col(c).alias(f"a_{c}") for c in ("producer_id", "scope", "mode", "finalization_ref")]).join(granted.select("authority_ref", *[F.col(c).alias(f"a_{c}") for c in ("n", "h1", "h2", "unnamed")]), "authority_ref", "left").withColumn("known", F.lit(True))
    out = observations.select(*key, "mode", "authority_ref", "status", "finalization_ref").join(sums, key, "left").join(granted, "authority_ref", "left")
    yes, n = lambda c: F.coalesce(F.col(c), F.lit(False)), F.coalesce("n", F.lit(0))
    fits = F.col("known").isNotNull() & ~yes("a_unnamed") & (F.coalesce("a_n", F.lit(0)) == n) & F.col("a_finalization_ref").eqNullSafe(F.col("finalization_ref"))
    for c in ("producer_id", "scope", "mode"):
        fits = fits & F.col(f"a_{c}").eqNullSafe(F.col(c))
    fits = fits & ((n == 0) | (F.col("a_h1").eqNullSafe(F.col("h1")) & F.col("a_h2").eqNullSafe(F.col("h2"))))
    mode = F.col("mode")
    code = (
        F.when(yes("unnamed") | ~F.coalesce(mode.isin("none", "absence", "explicit_source"), F.lit(False)), "deletion").when((mode == "none") & (F.col("authority_ref").isNotNull() | (n > 0)), "deletion")
        .when((mode == "absence") & (~F.col("status").eqNullSafe(F.lit("complete")) | yes("not_removed") | yes("not_prior")), "deletion").when((mode == "explicit_source") & (yes("has_current") | yes("not_all")), "deletion").when((mode != "none") & ~fits, "authority")
    )
    return out.select(*key, "mode", "authority_ref", n.cast("long").alias("n_targets"), code.alias("code"))


def tombstones(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """producer_id, scope, observation_id, chunk_id, authority_ref: the targets of deletions of decide_deletions() that hold."""
    good = decisions.where("code IS NULL AND mode <> 'none'").select(*OBSERVATION, "authority_ref")
    return targets.select(*OBSERVATION, "chunk_id").distinct().join(good, list(OBSERVATION)).select(*OBSERVATION, "chunk_id", "authority_ref")


def authorize_deletions(requests: DataFrame, authorities: DataFrame, removed: DataFrame, prior: DataFrame) -> DataFrame:
    """requests (producer_id, scope, mode, authority_ref, scan_complete) -> tombstones: scope, chunk_id, authority_ref.

    `absence` needs a complete scan and deletes what was removed; `explicit_source` deletes all of the prior
    inventory; both need an authority of the same producer, scope and mode. `none` deletes nothing. Inventories of several
    producers carry producer_id, and a producer's authority reaches its own chunks alone; decide_deletions() looks at targets as well."""
    a = authorities.select("authority_ref", "producer_id", "scope", "mode")
    allowed = requests.join(a, ["authority_ref", "producer_id", "scope", "mode"], "left_semi")
    own = lambda df: [c for c in ("producer_id", "scope") if c in df.columns]
    gone = allowed.where("mode = 'absence' AND scan_complete").join(removed.select(*own(removed), "chunk_id"), own(removed))
    all_ = allowed.where("mode = 'explicit_source'").join(prior.select(*own(prior), "chunk_id"), own(prior))
    return gone.select("scope", "chunk_id", "authority_ref").unionByName(all_.select("scope", "chunk_id", "authority_ref"))


DECISION = "producer_id string, scope string, observation_id string, seq long, decision string, head string"


class Acceptance:
    """The fold over one scope's observations in order of arrival; what is kept is small per observation."""

    def __init__(self, head: str | None = None, seen: dict | None = None, decisions: dict | None = None, revisions: dict | None = None):
        self.head, self.seen, self.decisions, self.revisions = head, seen or {}, decisions or {}, revisions or {}

    def take(self, observation_id: str, digest: str, revision: str, prior: str | None, projection: str) -> str:
        """The decision: a replay gives the stored one; failures change nothing but are not stored either."""
        if observation_id in self.seen:
            return self.decisions[observation_id] if self.seen[observation_id] == digest else "conflicting_retry"
        if (prior or None) != self.head:
            return "precondition"
        if self.revisions.get(revision, projection) != projection:
            return "revision"
        self.seen[observation_id], self.decisions[observation_id] = digest, "accepted"
        self.revisions[revision], self.head = projection, revision
        return "accepted"


def fold_rows(state: Acceptance, rows: pd.DataFrame, key: tuple) -> pd.DataFrame:
    none = lambda v: None if v is None or v != v else v
    out = []
    for r in rows.sort_values("seq", kind="stable").itertuples(index=False):
        decision = state.take(r.observation_id, r.payload_digest, r.revision_ref, none(r.expected_prior), r.projection)
        out.append((key[0], key[1], r.observation_id, r.seq, decision, state.head))
    return pd.DataFrame(out, columns=["producer_id", "scope", "observation_id", "seq", "decision", "head"])


OBSERVED = ("producer_id", "scope", "observation_id", "seq", "payload_digest", "revision_ref", "expected_prior", "projection")


def accept_observations(observations: DataFrame) -> DataFrame:
    """A decision for each observation of a batch, in order of seq within its producer and scope.

    The order within a scope is inherent (each decision depends on the head before it). A scope's rows stream through
    one task in batches; what is held is the scope's state, not its rows."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Acceptance()
        for batch in batches:
            for found, rows in batch.groupby(list(SCOPE), sort=False, dropna=False):
                found = tuple(None if x is None or x != x else x for x in found)
                if found != key:
                    key, state = found, Acceptance()
                yield fold_rows(state, rows, found)

    ordered = observations.select(*OBSERVED).repartition(*SCOPE).sortWithinPartitions(*SCOPE, "seq", "observation_id", "payload_digest")
    return ordered.mapInPandas(fold, DECISION)
