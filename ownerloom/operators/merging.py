"""Owners of two and three revisions: matching, classification, gates, keyed and archive merges, order.

Owners are rows (case_id, owner_id, path, fingerprint, pos, text). Revisions are compared by one
conditional aggregation over (case_id, owner_id), so a large case is spread over its owners.
"""

from __future__ import annotations

from collections import Counter, deque
from functools import cmp_to_key
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.sources.scratch import shuffled, spread

ROLES = ("base", "ours", "theirs")


def match_by_path(template: DataFrame, destination: DataFrame, key: str = "path") -> DataFrame:
    """case_id, key, occurrence, template_pos, destination_pos: the n-th owner of a path meets the n-th on
    the other side; one side is null where it has none. Occurrence numbers make the join one to one."""
    order = Window.partitionBy("case_id", key).orderBy("pos")
    side = lambda df, name: df.select("case_id", key, F.row_number().over(order).alias("occurrence"), F.col("pos").alias(name))
    return side(template, "template_pos").join(shuffled(side(destination, "destination_pos")), ["case_id", key, "occurrence"], "full_outer")


def match_text_exact(template: DataFrame, destination: DataFrame) -> DataFrame:
    """Equal normalized blocks of a case: each destination block takes the earliest unused template block."""
    found = match_by_path(template.select("case_id", "normalized", F.col("index").alias("pos")), destination.select("case_id", "normalized", F.col("index").alias("pos")), "normalized")
    return found.select("case_id", F.col("template_pos").alias("template_index"), F.col("destination_pos").alias("destination_index"))


def _greedy_pairs(template: list[dict], destination: list[dict]) -> list[tuple[int, int]]:
    """Nodes (pos, names) of both sides in order -> pairs: a node takes the first of its names that a free node has, and
    of those nodes the first. Each place leaves a name's queue once."""
    waiting: dict[str, deque[int]] = {}
    for node in destination:
        for name in dict.fromkeys(node["names"]):
            waiting.setdefault(name, deque()).append(node["pos"])
    used, pairs = set(), []
    for node in template:
        for name in node["names"]:
            queue = waiting.get(name)
            while queue and queue[0] in used:
                queue.popleft()
            if queue:
                used.add(queue[0])
                pairs.append((node["pos"], queue.popleft()))
                break
    return pairs


def match_identities(template: DataFrame, destination: DataFrame) -> DataFrame:
    """case_id, template_pos, destination_pos by identity: node rows have primary and aliases.

    Primaries are matched first, by occurrence. What is left is matched greedily in template order: a node takes
    the first of its signatures (primary, then aliases in order) that a free node has, and of those nodes the first. That
    step sees one case's remainder at a time. A null primary is no signature.
    """
    flat = lambda df: df.withColumn("primary_key", F.to_json("primary"))
    t, d = flat(template), flat(destination)
    named = lambda df: df.where("primary_key IS NOT NULL").select("case_id", "primary_key", "pos")
    first = match_by_path(named(t), named(d), "primary_key")
    sure = first.where("template_pos IS NOT NULL AND destination_pos IS NOT NULL").select("case_id", "template_pos", "destination_pos")
    left = lambda df, name: df.join(shuffled(sure.select("case_id", F.col(name).alias("pos"))), ["case_id", "pos"], "left_anti").select("case_id", "pos", "primary_key", F.transform("aliases", lambda a: F.to_json(a)).alias("aliases"))

    @F.arrow_udf("array<struct<template_pos:long,destination_pos:long>>")
    def greedy(template: pa.Array, destination: pa.Array) -> pa.Array:
        return pa.array([_greedy_pairs(t, d) for t, d in zip(template.to_pylist(), destination.to_pylist(), strict=True)], pa.list_(pa.struct([("template_pos", pa.int64()), ("destination_pos", pa.int64())])))

    # A case whose other side has nothing left needs no step; many small cases share a batch.
    listed = lambda df, name: df.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.array_compact(F.concat(F.array("primary_key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("names")))).alias(name))
    both = shuffled(listed(left(t, "template_pos"), "a")).join(listed(left(d, "destination_pos"), "b"), "case_id")
    rest = both.select("case_id", F.explode(greedy("a", "b")).alias("m")).select("case_id", *[F.col(f"m.{c}").cast(sure.schema[c].dataType).alias(c) for c in ("template_pos", "destination_pos")])
    return sure.unionByName(rest)


def structural_matches(before: DataFrame, after: DataFrame) -> DataFrame:
    """moved (one signature at another place), rename (one body under another signature) and ambiguous rows.

    Nodes: case_id, signature, parent, pos, body_hash. A signature with more than one node on a side is ambiguous,
    and so is a gone signature whose body stands on both sides and more than once on one of them; before_candidates
    and after_candidates count the nodes of that body (null in all other rows)."""
    a, b = before.alias("a"), after.alias("b")
    count = Window.partitionBy("case_id", "signature")
    many = lambda df: df.withColumn("n", F.count("*").over(count)).where("n > 1").select("case_id", "signature").distinct()
    ambiguous = many(before).union(many(after)).distinct()
    moved = a.join(b, ["case_id", "signature"]).where("a.parent <> b.parent OR a.pos <> b.pos").select("case_id", "signature", F.col("signature").alias("to_signature"), F.lit("moved").alias("kind"), F.lit(0).alias("distance"))
    moved = moved.join(ambiguous, ["case_id", "signature"], "left_anti")
    gone = before.join(after.select("case_id", "signature"), ["case_id", "signature"], "left_anti").alias("a")
    new = after.join(before.select("case_id", "signature"), ["case_id", "signature"], "left_anti").alias("b")
    # Bodies that stand more than once on a side name no rename; that also bounds the join to one to one.
    once = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("case_id", "body_hash"))).where("n = 1").drop("n")
    renamed = once(gone).alias("a").join(once(new).alias("b"), ["case_id", "body_hash"]).select("case_id", F.col("a.signature").alias("signature"), F.col("b.signature").alias("to_signature"), F.lit("rename").alias("kind"), F.levenshtein("a.signature", "b.signature").alias("distance"))
    told = ambiguous.select("case_id", "signature", F.lit(None).cast("string").alias("to_signature"), F.lit("ambiguous").alias("kind"), F.lit(0).alias("distance"))
    bodies = lambda df, n: df.groupBy("case_id", "body_hash").agg(F.count("*").alias(n))
    many_bodies = bodies(gone, "before_candidates").join(bodies(new, "after_candidates"), ["case_id", "body_hash"]).where("before_candidates > 1 OR after_candidates > 1")
    unsure = gone.select("case_id", "signature", "body_hash").distinct().join(many_bodies, ["case_id", "body_hash"]).join(ambiguous, ["case_id", "signature"], "left_anti")
    unsure = unsure.select("case_id", "signature", F.lit(None).cast("string").alias("to_signature"), F.lit("ambiguous").alias("kind"), F.lit(0).alias("distance"), "before_candidates", "after_candidates")
    return moved.unionByName(renamed).unionByName(told).unionByName(unsure, allowMissingColumns=True)


def owner_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, owner_id, change (added, deleted, edited), change_id (numbered from 0: before order, then new owners in
    after order), before_path and after_path (null where a side has no such owner)."""
    side = lambda df, n: df.select("case_id", "owner_id", *[F.col(c).alias(f"{n}_{c}") for c in ("text", "path", "pos")])
    both = side(before, "a").join(side(after, "b"), ["case_id", "owner_id"], "full_outer")
    change = F.when(F.col("a_pos").isNull(), "added").when(F.col("b_pos").isNull(), "deleted").when(~F.col("a_text").eqNullSafe(F.col("b_text")) | ~F.col("a_path").eqNullSafe(F.col("b_path")), "edited")
    rows = both.withColumn("change", change).where("change IS NOT NULL")
    order = Window.partitionBy("case_id").orderBy(F.col("a_pos").isNull(), F.coalesce("a_pos", "b_pos"))
    return rows.select("case_id", "owner_id", "change", F.concat(F.lit("change-"), F.row_number().over(order) - 1).alias("change_id"), F.col("a_path").alias("before_path"), F.col("b_path").alias("after_path"))


def directional_classify(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """case_id, owner_id, decision; an owner under another path is an error row (decision null, error set)."""
    side = lambda df, n: df.select("case_id", "owner_id", F.col("text").alias(f"{n}_text"), F.col("path").alias(f"{n}_path"), F.lit(True).alias(n))
    both = side(incoming, "i").join(side(current, "c"), ["case_id", "owner_id"], "full_outer")
    clash = F.col("i").isNotNull() & F.col("c").isNotNull() & ~F.col("i_path").eqNullSafe(F.col("c_path"))
    decision = F.when(clash, None).when(F.col("i").isNull(), "retain_current_only").when(F.col("c").isNull(), "add_incoming_only").when(F.col("i_text").eqNullSafe(F.col("c_text")), "retain_identical_current").otherwise("prefer_current")
    return both.select("case_id", "owner_id", decision.alias("decision"), F.when(clash, "owner_path_changed").alias("error"))


def _decision(b: Column, o: Column, t: Column, b_in: Column, o_in: Column, t_in: Column) -> Column:
    """The eight cases of a three-way choice."""
    return (
        F.when(b_in & o_in & t_in, F.when(o.eqNullSafe(t) | b.eqNullSafe(t), "select_ours").when(b.eqNullSafe(o), "select_theirs").otherwise("conflict_edit_edit"))
        .when(b_in & o_in, F.when(b.eqNullSafe(o), "delete").otherwise("conflict_delete_modify"))
        .when(b_in & t_in, F.when(b.eqNullSafe(t), "delete").otherwise("conflict_delete_modify"))
        .when(b_in, "delete")
        .when(o_in & t_in, F.when(o.eqNullSafe(t), "select_ours").otherwise("conflict_add_add"))
        .when(o_in, "select_ours")
        .otherwise("select_theirs")
    )


def three_way_classify(owners: DataFrame) -> DataFrame:
    """owners of all roles -> case_id, owner_id, decision, category, selected role and the three alternatives.

    One shuffle by (case_id, owner_id) with partial aggregation; roles are columns of the aggregate.
    """
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    found = lambda role: F.max(F.when(F.col("role") == role, F.lit(1)))
    aggs = [of(r, c).alias(f"{r}_{c}") for r in ROLES for c in ("fingerprint", "text", "path", "pos")] + [found(r).alias(f"{r}_in") for r in ROLES]
    rows = owners.groupBy("case_id", "owner_id").agg(*aggs)
    is_in = {r: F.col(f"{r}_in").isNotNull() for r in ROLES}
    decision = _decision(*[F.col(f"{r}_fingerprint") for r in ROLES], *is_in.values())
    rows = rows.withColumn("decision", decision)
    conflict = F.startswith("decision", F.lit("conflict"))
    # All owner conflicts but additions are told as edit_edit to the reader of the conflict.
    category = F.when(F.col("decision") == "conflict_add_add", "add_add").when(conflict, "edit_edit")
    selected = F.when(F.col("decision") == "select_ours", "ours").when(F.col("decision") == "select_theirs", "theirs")
    alternatives = F.array(*[F.struct(F.lit(r).alias("revision"), F.when(is_in[r], "present").otherwise("absent").alias("state"), F.col(f"{r}_text").alias("region")) for r in ROLES])
    return rows.select("case_id", "owner_id", "decision", category.alias("category"), selected.alias("selected"), F.when(conflict, alternatives).alias("alternatives"), *[f"{r}_pos" for r in ROLES])


def whole_source(owners: DataFrame) -> DataFrame:
    """case_id, whole_source: ours or theirs where two revisions of a case are the same source, else null.

    A revision's digest is an order-free sum of its owners' hashes with their places, so no case is
    gathered in one task; (sum, count) stand for the source."""
    piece = F.xxhash64("owner_id", "pos", "fingerprint").cast("decimal(38,0)")
    sums = owners.groupBy("case_id").agg(*[F.struct(F.coalesce(F.sum(F.when(F.col("role") == r, piece)), F.lit(0)).alias("s"), F.count(F.when(F.col("role") == r, 1)).alias("n")).alias(r) for r in ROLES])
    same = lambda a, b: (F.col(f"{a}.s") == F.col(f"{b}.s")) & (F.col(f"{a}.n") == F.col(f"{b}.n"))
    return sums.select("case_id", F.when(same("ours", "theirs") | same("base", "theirs"), "ours").when(same("base", "ours"), "theirs").alias("whole_source"))


def merge_preconditions(owners: DataFrame, decisions: DataFrame) -> DataFrame:
    """case_id, outcome (clean, conflict, error) and why, from owners and three_way_classify().

    The selected owners must be ours', theirs', or extend ours; owners in all revisions must stand in
    one order in ours and theirs. Orders are compared by neighbours: an owner's predecessor among the
    stable ones must be the same, which needs no list of a case's owners.
    """
    kept = F.col("selected").isNotNull()
    member = decisions.groupBy("case_id").agg(
        F.count_if(F.startswith("decision", F.lit("conflict"))).alias("conflicts"),
        F.count_if(kept & F.col("ours_pos").isNull()).alias("beyond_ours"), F.count_if(~kept & F.col("ours_pos").isNotNull()).alias("lost_ours"),
        F.count_if(kept & F.col("theirs_pos").isNull()).alias("beyond_theirs"), F.count_if(~kept & F.col("theirs_pos").isNotNull()).alias("lost_theirs"),
    )
    stable = decisions.where("base_pos IS NOT NULL AND ours_pos IS NOT NULL AND theirs_pos IS NOT NULL")
    before = lambda role: F.lag("owner_id").over(Window.partitionBy("case_id").orderBy(f"{role}_pos"))
    order = stable.select("case_id", before("ours").alias("o"), before("theirs").alias("t")).groupBy("case_id").agg(F.count_if(~F.col("o").eqNullSafe(F.col("t"))).alias("out_of_order"))
    rows = member.join(order, "case_id", "left").join(whole_source(owners), "case_id")
    ours = (F.col("beyond_ours") == 0) & (F.col("lost_ours") == 0)
    theirs = (F.col("beyond_theirs") == 0) & (F.col("lost_theirs") == 0)
    outcome = (
        F.when(F.col("whole_source").isNotNull(), F.struct(F.lit("clean").alias("outcome"), F.concat(F.lit("whole_source_"), "whole_source").alias("why")))
        .when(F.col("conflicts") > 0, F.struct(F.lit("conflict").alias("outcome"), F.lit("owner_conflict").alias("why")))
        .when(~(ours | theirs | (F.col("lost_ours") == 0)), F.struct(F.lit("error").alias("outcome"), F.lit("membership").alias("why")))
        .when(F.coalesce("out_of_order", F.lit(0)) > 0, F.struct(F.lit("error").alias("outcome"), F.lit("owner_order").alias("why")))
        .otherwise(F.struct(F.lit("clean").alias("outcome"), F.when(ours, "ours").when(theirs, "theirs").otherwise("ours_extended").alias("why")))
    )
    return rows.select("case_id", outcome.alias("r")).select("case_id", "r.outcome", "r.why")


def owner_union(owners: DataFrame) -> DataFrame:
    """case_id, owner_id, rank (from 0): all owners in first-seen order, base before ours before theirs."""
    rank = F.when(F.col("role") == "base", 0).when(F.col("role") == "ours", 1).otherwise(2)
    first = owners.groupBy("case_id", "owner_id").agg(F.min(F.struct(rank.alias("role_rank"), "pos")).alias("seen"))
    order = Window.partitionBy("case_id").orderBy("seen")
    return first.select("case_id", "owner_id", (F.row_number().over(order) - 1).alias("rank"))


def merge_comment_delta(cases: DataFrame) -> DataFrame:
    """cases (base, ours, theirs: optional comments) with merged and conflict (edit_edit, delete_edit)."""
    b, o, t = F.col("base"), F.col("ours"), F.col("theirs")
    clean = F.when(o.eqNullSafe(t) | b.eqNullSafe(t), F.struct(F.lit(True).alias("ok"), o.alias("v"))).when(b.eqNullSafe(o), F.struct(F.lit(True).alias("ok"), t.alias("v")))
    conflict = F.when(clean.isNull(), F.when(o.isNull() | t.isNull(), "delete_edit").otherwise("edit_edit"))
    return cases.withColumns({"merged": clean.getField("v"), "conflict": conflict})


def merge_keyed_members(members: DataFrame) -> DataFrame:
    """members (case_id, side base|left|right, pos, key, value) -> case_id, key, value, rank, resolved.

    Later edits replace earlier ones; keys stand in first-seen order. A case in which left and right
    leave one key with different values is unresolved: one row with null key."""
    side = F.when(F.col("side") == "base", 0).when(F.col("side") == "left", 1).otherwise(2)
    m = members.withColumn("at", F.struct(side.alias("s"), "pos"))
    last_left = F.max_by(F.when(F.col("side") == "left", F.col("value")), F.when(F.col("side") == "left", F.col("pos")))
    right = lambda f: f(F.when(F.col("side") == "right", F.col("value")))
    keys = m.groupBy("case_id", "key").agg(F.min("at").alias("first"), F.max_by("value", "at").alias("value"), last_left.alias("l"), right(F.min).alias("r_min"), right(F.max).alias("r_max"))
    # Any right edit that differs from left's last value, or from an earlier right edit, is a clash once left has the key.
    keys = keys.withColumn("clash", F.coalesce(F.col("l").isNotNull() & ((F.col("r_min") != F.col("l")) | (F.col("r_max") != F.col("l"))), F.lit(False)))
    # One sort serves both windows.
    by_case = Window.partitionBy("case_id").orderBy("first")
    whole = by_case.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = spread(keys, members.count(), "case_id").withColumns({"bad": F.max("clash").over(whole), "rank": F.row_number().over(by_case) - 1})
    good = rows.where(~F.col("bad")).select("case_id", "key", "value", "rank", F.lit(True).alias("resolved"))
    bad = rows.where(F.col("bad") & (F.col("rank") == 0)).select("case_id", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(0).alias("rank"), F.lit(False).alias("resolved"))
    return good.unionByName(bad)


def union_commutative_children(nodes: DataFrame) -> DataFrame:
    """nodes (case_id, parent_policy, side base|left|right, pos, node_id, signature) -> the union by signature
    (else node id) in first-seen order, resolved true; a case without a commutative parent gives one row with
    resolved false and no node."""
    side = F.when(F.col("side") == "base", 0).when(F.col("side") == "left", 1).otherwise(2)
    key = F.when(F.coalesce("signature", F.lit("")) == "", F.col("node_id")).otherwise(F.col("signature"))
    first = nodes.where("parent_policy = 'commutative'").groupBy("case_id", key.alias("k")).agg(F.min(F.struct(side.alias("s"), "pos", "node_id")).alias("seen"))
    good = first.select("case_id", "seen.node_id", "k", (F.row_number().over(Window.partitionBy("case_id").orderBy("seen")) - 1).alias("rank"), F.lit(True).alias("resolved"))
    refused = nodes.where("parent_policy IS DISTINCT FROM 'commutative'").select("case_id").distinct()
    return good.unionByName(refused.withColumn("resolved", F.lit(False)), allowMissingColumns=True)


def normalize_archive_path(path: Column) -> Column:
    """`\\` to `/`, `.` and empty parts dropped, `..` takes the part before it."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.array_append(s, p))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def escapes_root(path: Column) -> Column:
    """True where a path is absolute or rises above its root on the way."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = lambda s, p: F.struct((s.d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), F.least(s.low, s.d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("low"))
    walk = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), step)
    return F.startswith(path, F.lit("/")) | (walk.low < 0)


def merge_archive_entries(entries: DataFrame) -> DataFrame:
    """entries (case_id, role ancestor|current|incoming, path, compression, sizes, crc32, encrypted) ->
    case_id, normalized_path, operation, nested_family, reason. Entries only in the ancestor give no row."""
    e = entries.withColumn("normalized_path", normalize_archive_path(F.col("path")))
    copies = Window.partitionBy("case_id", "role", "normalized_path")
    signing = F.startswith(F.upper("path"), F.lit("META-INF/")) & F.upper("path").rlike(r"\.(RSA|DSA|EC|SF)$")
    unsafe = F.when(escapes_root(F.col("path")), "path_traversal").when(F.count("*").over(copies) > 1, "duplicate_path").when(F.col("encrypted"), "encrypted").when(signing, "signing_sensitive")
    e = e.withColumn("unsafe", F.when(F.col("role") == "incoming", unsafe))
    same = F.struct("path", "compression", "compressed_size", "uncompressed_size", "crc32")
    of = lambda role: F.max(F.when(F.col("role") == role, same))
    rows = e.groupBy("case_id", "normalized_path").agg(of("ancestor").alias("a"), of("current").alias("c"), of("incoming").alias("i"), F.max("unsafe").alias("unsafe"))
    rows = rows.where("unsafe IS NOT NULL OR c IS NOT NULL OR i IS NOT NULL")
    lower = F.lower("normalized_path")
    family = F.when(lower.rlike(r"\.(md|markdown)$"), "markdown").when(lower.rlike(r"\.json$"), "json").when(lower.rlike(r"\.ya?ml$"), "yaml").when(lower.rlike(r"\.xml$"), "xml")
    unchanged = F.col("a").isNotNull() & (F.col("c") == F.col("a")) & (F.col("i") == F.col("a"))
    operation = F.when(F.col("unsafe").isNotNull(), "reject").when(F.col("c").isNull(), "add").when(F.col("i").isNull(), "delete").when(unchanged, "preserve").when(family.isNotNull(), "delegate").otherwise("rewrite")
    return rows.select("case_id", "normalized_path", operation.alias("operation"), F.when(operation == "delegate", family).alias("nested_family"), F.col("unsafe").alias("reason"))


def _twice(ids: list[str]) -> list[str]:
    return sorted(x for x, n in Counter(ids).items() if n > 1)


def _node_order(chosen: list[str], sequences: list[list[str]]) -> dict:
    """The answer of merge_order() for one case."""
    import heapq

    answer = lambda status, ids: {"status": status, "node_ids": ids}
    keep, rank, after, before = set(chosen), {}, {}, dict.fromkeys(chosen, 0)
    if len(keep) < len(chosen):
        return answer("duplicate_selection", _twice(chosen))
    for ids in sequences:
        if len(set(ids)) < len(ids):
            return answer("duplicate_identity", _twice(ids))
        ids = [x for x in ids if x in keep]
        for x in ids:
            rank.setdefault(x, len(rank))
        for a, b in zip(ids, ids[1:], strict=False):
            if b not in after.setdefault(a, {}):
                after[a][b] = True
                before[b] += 1
    for x in chosen:
        rank.setdefault(x, len(rank))
    ready = [(rank[x], x) for x, n in before.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        _, x = heapq.heappop(ready)
        out.append(x)
        for y in after.get(x, ()):
            before[y] -= 1
            if not before[y]:
                heapq.heappush(ready, (rank[y], y))
    if len(out) == len(chosen):
        return answer("ordered", out)
    return answer("incompatible_order", sorted((x for x, n in before.items() if n > 0), key=rank.__getitem__))


def merge_order(sequences: DataFrame, selected: DataFrame) -> DataFrame:
    """sequences (case_id, sequence, pos, node_id), selected (case_id, pos, node_id) -> case_id, status
    (ordered, duplicate_selection, duplicate_identity, incompatible_order), node_ids.

    Neighbours in each sequence constrain the order; ties go to the node seen first. The order of one case
    is one document's, so it is found in one row; the work there is linear but for the ready heap.
    """
    rows = sequences.select("case_id", F.col("sequence").cast("int").alias("sequence"), "pos", "node_id").unionByName(selected.select("case_id", F.lit(None).cast("int").alias("sequence"), "pos", "node_id"))
    node = F.struct("sequence", F.col("pos").cast("long").alias("pos"), F.col("node_id").cast("string").alias("id"))
    listed = lambda test: F.sort_array(F.collect_list(F.when(test, node)))
    cases = rows.groupBy("case_id").agg(listed(F.col("sequence").isNull()).alias("chosen"), listed(F.col("sequence").isNotNull()).alias("nodes"))

    @F.arrow_udf("struct<status:string,node_ids:array<string>>")
    def ordered(chosen: pa.Array, nodes: pa.Array) -> pa.Array:
        cases = zip(chosen, nodes, strict=True)
        return pa.array([_node_order([n["id"] for n in c.as_py()], [[n["id"] for n in part] for _, part in groupby(s.as_py(), itemgetter("sequence"))]) for c, s in cases], pa.struct([("status", pa.string()), ("node_ids", pa.list_(pa.string()))]))

    # Many small cases share a batch.
    return cases.select("case_id", ordered("chosen", "nodes").alias("o")).select("case_id", "o.status", "o.node_ids")


def _straight_pairs(places: list[int]) -> int:
    """How many pairs of distinct places from 0 on stand in their order."""
    counts, pairs = [0] * (len(places) + 1), 0
    for n, at in enumerate(places):
        k = at
        while k:
            pairs += counts[k]
            k &= k - 1
        k = at + 1
        while k <= len(places):
            counts[k] += 1
            k += k & -k
    return pairs


def _pairwise_order(stable: list[str], ours: dict[str, int], theirs: dict[str, int]) -> list[str] | None:
    """The order of stable owners (in base's order) in which two keep base's order if both tips keep it, and else stand the other
    way round; None if there is none, as the pairs go round in a cycle.

    Sorting finds the only candidate. It holds if no pair is kept that a tip turned, and if as many are kept as both tips keep."""
    base = {x: k for k, x in enumerate(stable)}
    ours, theirs = ({x: k for k, x in enumerate(sorted(stable, key=tip.__getitem__))} for tip in (ours, theirs))

    def compare(x: str, y: str) -> int:
        x_above = base[x] < base[y]
        kept = (ours[x] < ours[y]) == x_above and (theirs[x] < theirs[y]) == x_above
        return -1 if kept == x_above else 1

    out = sorted(stable, key=cmp_to_key(compare))
    at = {x: k for k, x in enumerate(out)}
    for tip in (ours, theirs):
        # The largest place in the tip of those that stand above both in base and in the order.
        most = [-1] * (len(stable) + 1)
        for x in stable:
            k = at[x]
            while k:
                if most[k] > tip[x]:
                    return None
                k &= k - 1
            k = at[x] + 1
            while k <= len(stable):
                most[k] = max(most[k], tip[x])
                k += k & -k
    # Of three orders a pair stands alike in all, or in two of them only: so counts for two at a time tell how many all share.
    n = len(stable) * (len(stable) - 1) // 2
    by_ours = sorted(stable, key=ours.__getitem__)
    alike = _straight_pairs([ours[x] for x in stable]) + _straight_pairs([theirs[x] for x in stable]) + _straight_pairs([theirs[x] for x in by_ours])
    return out if _straight_pairs([at[x] for x in stable]) == (alike - n) // 2 else None


def _owner_order(base: list[str], ours: list[str], theirs: list[str], wanted: list[str]) -> dict:
    """The answer of merge_owner_order() for one case."""
    import heapq

    answer = lambda status, ids: {"status": status, "owner_ids": ids}
    if not base or not wanted or any(len(set(x)) < len(x) or "" in x for x in (base, ours, theirs, wanted)):
        return answer("unsupported", [])
    keep, in_ours, in_theirs = set(wanted), {x: k for k, x in enumerate(ours)}, {x: k for k, x in enumerate(theirs)}
    if not keep <= in_ours.keys() | in_theirs.keys():
        return answer("unsupported", [])
    stable = _pairwise_order([x for x in base if x in keep and x in in_ours and x in in_theirs], in_ours, in_theirs)
    if stable is None:
        return answer("cycle", [])
    fixed = set(stable)
    after: dict[str, set] = {x: set() for x in keep}
    for x, y in zip(stable, stable[1:], strict=False):
        after[x].add(y)
    for tip in (ours, theirs):
        chosen = [x for x in tip if x in keep]
        for x, y in zip(chosen, chosen[1:], strict=False):
            if x not in fixed or y not in fixed:
                after[x].add(y)
        for way in (1, -1):
            near = None
            for x in tip[::way]:
                if x in fixed:
                    near = x
                elif x in keep and near is not None:
                    (after[near] if way == 1 else after[x]).add(x if way == 1 else near)
    rank: dict[str, tuple] = {}
    for k, part in enumerate((base, ours, theirs)):
        for n, x in enumerate(part):
            rank.setdefault(x, (k, n))
    before = dict.fromkeys(keep, 0)
    for x, ys in after.items():
        ys.discard(x)
        for y in ys:
            before[y] += 1
    ready = [(rank[x], x) for x, n in before.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        _, x = heapq.heappop(ready)
        out.append(x)
        for y in after[x]:
            before[y] -= 1
            if not before[y]:
                heapq.heappush(ready, (rank[y], y))
    return answer("ordered", out) if len(out) == len(keep) else answer("cycle", [])


def merge_owner_order(owners: DataFrame, selected: DataFrame) -> DataFrame:
    """owners (case_id, role, pos, owner_id), selected (case_id, owner_id) -> case_id, status (ordered, cycle, unsupported)
    and owner_ids.

    Two owners that all revisions have keep base's order if both tips keep it, and else stand the other way round.
    Other owners stand between the nearest such owners of their tip and next to their selected neighbours. Ties go to
    base's order, then ours', then theirs'. Unsupported: an empty base or selection, an id that is empty or stands twice in a
    revision, a selected owner that no tip has.

    The order of the stable owners is sorted and checked by counts of pairs, see _pairwise_order(); no pairs are listed. The order of one
    case is one document's and is found in one row."""
    node = F.struct(F.col("pos").cast("long").alias("pos"), F.col("owner_id").cast("string").alias("id"))
    rows = owners.select("case_id", F.col("role").cast("string").alias("role"), node.alias("node")).unionByName(selected.select("case_id", F.lit("selected").alias("role"), F.struct(F.lit(0).cast("long").alias("pos"), F.col("owner_id").cast("string").alias("id")).alias("node")))
    of = lambda role: F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("node")))), lambda n: n.id)
    cases = rows.groupBy("case_id").agg(*[of(r).alias(r) for r in (*ROLES, "selected")])

    @F.arrow_udf("struct<status:string,owner_ids:array<string>>")
    def ordered(base: pa.Array, ours: pa.Array, theirs: pa.Array, selected: pa.Array) -> pa.Array:
        return pa.array([_owner_order(*[x.as_py() for x in lists]) for lists in zip(base, ours, theirs, selected, strict=True)], pa.struct([("status", pa.string()), ("owner_ids", pa.list_(pa.string()))]))

    # Many small cases share a batch.
    return cases.select("case_id", ordered(*ROLES, "selected").alias("o")).select("case_id", "o.status", "o.owner_ids")


def render_merged(owners: DataFrame, decisions: DataFrame, separator: str = "\n") -> DataFrame:
    """case_id, output and n_owners of cases without conflicts: ours' owners in ours' order with the selected
    text, then what theirs adds in theirs' order. One document is one row, as in the input."""
    bad = decisions.where(F.startswith("decision", F.lit("conflict"))).select("case_id").distinct()
    chosen = decisions.where("selected IS NOT NULL").join(bad, "case_id", "left_anti")
    text = owners.select("case_id", "owner_id", F.col("role").alias("selected"), "text")
    rows = chosen.join(text, ["case_id", "owner_id", "selected"])
    at = F.struct(F.col("ours_pos").isNull().alias("added"), F.coalesce("ours_pos", "theirs_pos").alias("pos"), "text")
    return rows.groupBy("case_id").agg(F.sort_array(F.collect_list(at)).alias("parts")).select("case_id", F.array_join(F.transform("parts", lambda p: p.text), separator).alias("output"), F.size("parts").cast("long").alias("n_owners"))


def merged_segments(owners: DataFrame, decisions: DataFrame, separator: str = "\n") -> DataFrame:
    """Evidence for render_merged(): case_id, segment_id (the owner), revision it was taken from, out_start and out_end (bytes
    of the output) and sha256, in cases without conflicts. Separators lie between segments. A case's places are running sums
    over a window of the case; no text is gathered."""
    bad = decisions.where(F.startswith("decision", F.lit("conflict"))).select("case_id").distinct()
    chosen = decisions.where("selected IS NOT NULL").join(bad, "case_id", "left_anti")
    rows = chosen.join(owners.select("case_id", "owner_id", F.col("role").alias("selected"), "text"), ["case_id", "owner_id", "selected"])
    w = Window.partitionBy("case_id").orderBy(F.col("ours_pos").isNull(), F.coalesce("ours_pos", "theirs_pos")).rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("text").cast("long")
    start = F.coalesce(F.sum(size + len(separator.encode())).over(w), F.lit(0))
    return rows.select("case_id", F.col("owner_id").alias("segment_id"), F.col("selected").alias("revision"), start.alias("out_start"), (start + size).alias("out_end"), F.sha2("text", 256).alias("sha256"))


def render_conflict_documents(owners: DataFrame, decisions: DataFrame, marker_size: int = 7, labels: tuple[str, str, str] = ("ours", "base", "theirs")) -> DataFrame:
    """case_id, output, n_conflicts of cases with conflicts: ours' owners in their order, each conflicting one in its block;
    blocks that ours has no owner for stand at the end, in theirs' order, then base's. One document is one row, as in the input."""
    blocks = render_conflicts(decisions, marker_size, labels).withColumn("block", F.regexp_replace("block", r"\n\z", ""))
    hit = blocks.select("case_id").distinct()
    ours = owners.where("role = 'ours'").join(hit, "case_id", "left_semi").select("case_id", "owner_id", "pos", "text")
    laid = ours.join(blocks, ["case_id", "owner_id"], "left").select("case_id", F.lit(0).alias("side"), F.col("pos").cast("long").alias("pos"), F.coalesce("block", "text").alias("text"), F.col("block").isNotNull().alias("is_block"))
    absent = decisions.where("ours_pos IS NULL").select("case_id", "owner_id", F.when(F.col("theirs_pos").isNotNull(), 1).otherwise(2).alias("side"), F.coalesce("theirs_pos", "base_pos").cast("long").alias("pos"))
    added = blocks.join(absent, ["case_id", "owner_id"]).select("case_id", "side", "pos", F.col("block").alias("text"), F.lit(True).alias("is_block"))
    rows = laid.unionByName(added).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("side", "pos", "text"))).alias("parts"), F.count_if("is_block").alias("n_conflicts"))
    return rows.select("case_id", F.concat(F.array_join(F.transform("parts", lambda p: p.text), "\n"), F.lit("\n")).alias("output"), "n_conflicts")


def render_conflicts(decisions: DataFrame, marker_size: int = 7, labels: tuple[str, str, str] = ("ours", "base", "theirs")) -> DataFrame:
    """case_id, owner_id, block: each conflicting owner between the four markers; an absent side is empty."""
    region = lambda r: F.coalesce(F.filter("alternatives", lambda a: a.revision == r)[0].region, F.lit(""))
    body = lambda r: F.when(region(r) == "", "").otherwise(F.concat(region(r), F.lit("\n")))
    mark = lambda c, label="": F.lit(c * marker_size + (f" {label}" if label else "") + "\n")
    block = F.concat(mark("<", labels[0]), body("ours"), mark("|", labels[1]), body("base"), mark("="), body("theirs"), mark(">", labels[2]))
    return decisions.where("alternatives IS NOT NULL").select("case_id", "owner_id", block.alias("block"))


def sequence_changes(base: DataFrame, side: DataFrame, identity: str = "owner_id") -> DataFrame:
    """case_id, identity, occurrence, kind (insert, delete, modify, move), base_pos and side_pos of one side against base.

    The n-th node of an identity is the n-th on the other side. A node moved if its neighbours among the nodes that
    both sides have differ between the two orders; a node may be modified and moved. Places are distinct in a case."""
    nth = Window.partitionBy("case_id", identity).orderBy("pos")
    nodes = lambda df, name: df.select("case_id", identity, F.row_number().over(nth).alias("occurrence"), F.col("pos").alias(f"{name}_pos"), F.col("fingerprint").alias(f"{name}_hash"))
    rows = nodes(base, "base").join(nodes(side, "side"), ["case_id", identity, "occurrence"], "full_outer")
    rows = rows.withColumn("matched", F.col("base_pos").isNotNull() & F.col("side_pos").isNotNull())
    as_base, as_side = (Window.partitionBy("case_id", "matched").orderBy(name) for name in ("base_pos", "side_pos"))
    stayed = F.lit(True)
    for step in (F.lag, F.lead):
        stayed = stayed & step("base_pos").over(as_base).eqNullSafe(step("base_pos").over(as_side))
    rows = rows.withColumn("stayed", stayed)
    kinds = F.array(
        F.when(F.col("base_pos").isNull(), "insert"),
        F.when(F.col("side_pos").isNull(), "delete"),
        F.when(F.col("matched") & ~F.col("base_hash").eqNullSafe(F.col("side_hash")), "modify"),
        F.when(F.col("matched") & ~F.col("stayed"), "move"),
    )
    return rows.select("case_id", identity, "occurrence", F.explode(F.array_compact(kinds)).alias("kind"), "base_pos", "side_pos")


def sequence_conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, identity: str = "owner_id") -> DataFrame:
    """case_id, category, identity, occurrence and base_pos of what two sides of a sequence cannot both have.

    delete_modify, modify_modify and duplicate_insertion are told by the n-th node of an identity in each revision. A case is
    told once as order (identity null) if both sides turn base nodes around and not in the same way; orders
    are compared by neighbours, without a list of a case's nodes."""
    nth = Window.partitionBy("case_id", identity).orderBy("pos")
    part = lambda df, role: df.select("case_id", identity, F.row_number().over(nth).alias("occurrence"), F.lit(role).alias("role"), "pos", F.col("fingerprint").alias("hash"))
    rows = part(base, "b").unionByName(part(ours, "o")).unionByName(part(theirs, "t"))
    of = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c))).alias(f"{role}_{c}")
    nodes = rows.groupBy("case_id", identity, "occurrence").agg(*[of(r, c) for r in "bot" for c in ("pos", "hash")])
    b, o, t = (F.col(f"{r}_pos").isNotNull() for r in "bot")
    bh, oh, th = (F.col(f"{r}_hash") for r in "bot")
    category = (
        F.when(b & ~o & t & (th != bh) | b & o & ~t & (oh != bh), "delete_modify").when(b & o & t & (oh != bh) & (th != bh) & (oh != th), "modify_modify").when(~b & o & t & (oh != th), "duplicate_insertion")
    )
    content = nodes.withColumn("category", category).where("category IS NOT NULL").select("case_id", "category", identity, "occurrence", F.col("b_pos").alias("base_pos"))

    def before(role: str) -> DataFrame:
        """The base place before each matched node in a side's order."""
        return nodes.where(f"b_pos IS NOT NULL AND {role}_pos IS NOT NULL").select("case_id", "b_pos", F.lag("b_pos").over(Window.partitionBy("case_id").orderBy(f"{role}_pos")).alias(role), F.lit(True).alias(f"in_{role}"))

    both = before("o").join(before("t"), ["case_id", "b_pos"], "full_outer")
    turned = lambda role: F.coalesce(F.bool_or(F.col(role) > F.col("b_pos")), F.lit(False))
    differ = F.bool_or(F.col("in_o").isNull() | F.col("in_t").isNull() | ~F.col("o").eqNullSafe(F.col("t")))
    order = both.groupBy("case_id").agg((turned("o") & turned("t") & differ).alias("bad")).where("bad").select("case_id", F.lit("order").alias("category"))
    return content.unionByName(order, allowMissingColumns=True)


def verify_byte_segments(segments: DataFrame) -> DataFrame:
    """segments (case_id, segment_id, src binary, src_start, src_end, out binary, out_start, out_end, sha256)
    -> case_id and the first error by place, null if all hold."""
    w = Window.partitionBy("case_id").orderBy("out_start", "segment_id")
    last = F.lead("out_start").over(w).isNull()
    part = lambda b, s, e: F.expr(f"substring({b}, cast({s} + 1 as int), cast({e} - {s} as int))")
    error = (
        F.when(F.count("*").over(Window.partitionBy("case_id", "segment_id")) > 1, "duplicate_id")
        .when(F.col("out_end") <= F.col("out_start"), "empty_range")
        .when(F.coalesce(F.lag("out_end").over(w), F.lit(0)) != F.col("out_start"), "gap")
        .when(last & (F.col("out_end") != F.octet_length("out")), "length")
        .when(part("src", "src_start", "src_end") != part("out", "out_start", "out_end"), "bytes")
        .when(F.sha2(part("out", "out_start", "out_end"), 256) != F.col("sha256"), "digest")
    )
    return segments.withColumn("error", error).groupBy("case_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("out_start"))).alias("error"))
