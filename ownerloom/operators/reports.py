"""Counts, scorecards, checks of benchmark tables, review groups and shard balance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.sources.scratch import written

#: Outcomes that are not scored, and the one that is a false automatic merge (fixed values).
FALSE_AUTO_MERGE = "false_auto_merge"
EXCLUDED = ("unsupported", "excluded_ambiguous")
#: Repositories that are placed one by one, and hash classes over which the others are summed.
GREEDY_ROWS, DEALT = 200_000, 1024
STATUS_RANK = {"experimental": 0, "available": 1, "recommended": 2}


def decision_summary(records: DataFrame) -> DataFrame:
    """records (decision, source) -> dimension (decision, source), value, n: both counts in one pass."""
    sets = records.groupingSets([["decision"], ["source"]], "decision", "source").agg(F.count("*").alias("n"), F.grouping("decision").alias("g"))
    return sets.select(F.when(F.col("g") == 0, "decision").otherwise("source").alias("dimension"), F.coalesce("decision", "source").alias("value"), "n")


def review_required(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.bool_or(F.col("decision") == "unresolved"), F.lit(False)).alias("review_required"))


def suite_summary(results: DataFrame) -> DataFrame:
    """results (suite, status) -> suite (null: all), total, passed, failed, skipped."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.rollup("suite").agg(F.count("*").alias("total"), n("passed"), n("failed"), n("skipped"))


def template_report(entries: DataFrame) -> DataFrame:
    """Entries per run by execution_action, write_action and written."""
    is_a = lambda c, *v: F.count_if(F.col(c).isin(*v))
    return entries.groupBy("run_id").agg(
        F.count_if((F.col("write_action") == "create") & F.col("written")).alias("created"), F.count_if((F.col("write_action") == "update") & F.col("written")).alias("updated"),
        is_a("execution_action", "keep").alias("kept"), is_a("execution_action", "blocked").alias("blocked"), is_a("execution_action", "omit").alias("omitted"), F.count_if("written").alias("written"),
    )


def template_convergence(entries: DataFrame) -> DataFrame:
    """run_id, converged: no entry is blocked and none that is ready differs from its destination."""
    fine = (F.col("execution_action") != "blocked") & ~(F.col("ready") & F.col("differs"))
    return entries.groupBy("run_id").agg(F.bool_and(fine).alias("converged"))


def benchmark_summary(results: DataFrame, outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """results (run_id, case_id, outcome), outcomes (outcome: what the contract knows), cases (case_id, score_eligible)
    -> a row per run and outcome, zero-filled, with the run's eligible and excluded results, its eligible false automatic
    merges and the safety gate. An outcome that the contract does not know has its row too, with known false.

    A result counts as eligible if its case is and its outcome is scored. Counts are partial sums; of results only
    run and outcome pairs reach the joins that fill in zeros."""
    rows = results.join(cases.select("case_id", "score_eligible"), "case_id", "left")
    excluded = F.col("outcome").isin(*EXCLUDED)
    eligible = F.coalesce("score_eligible", F.lit(False)) & ~excluded
    counts = rows.groupBy("run_id", "outcome").agg(F.count("*").alias("n"), F.count_if(eligible).alias("e"), F.count_if(excluded).alias("x"), F.count_if(eligible & (F.col("outcome") == FALSE_AUTO_MERGE)).alias("f"))
    runs = counts.groupBy("run_id").agg(F.sum("e").alias("eligible"), F.sum("x").alias("excluded"), F.sum("f").alias("false_auto_merges"))
    known = outcomes.select("outcome").distinct().withColumn("known", F.lit(True))
    grid = runs.select("run_id").join(F.broadcast(known)).unionByName(counts.select("run_id", "outcome").join(known, "outcome", "left_anti").withColumn("known", F.lit(False)))
    safety = F.when(F.col("false_auto_merges") == 0, "pass").otherwise("fail")
    out = grid.join(counts.select("run_id", "outcome", "n"), ["run_id", "outcome"], "left").join(runs, "run_id")
    return out.select("run_id", "outcome", "known", F.coalesce("n", F.lit(0)).alias("n"), "eligible", "excluded", "false_auto_merges", safety.alias("safety"))


def normalized_lines(text: Column) -> Column:
    """Lines without white space at their ends, each ended by a line feed; line feed, carriage return or both end a
    line, and blank lines stay. An empty text stays empty."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    whole = F.regexp_replace(unix, r"\n\z", "")
    return F.when(text == "", "").otherwise(F.concat(F.regexp_replace(whole, r"[ \t\x0B\f]+(?=\n|\z)", ""), F.lit("\n")))


def score_agreement(cases: DataFrame) -> DataFrame:
    """cases (case_id, expected, output) with exact, normalized (equal lines but for white space at their ends),
    markers and digest."""
    markers = F.contains("output", F.lit("<<<<<<<")) | F.contains("output", F.lit("======="))
    return cases.select("case_id", (F.col("output") == F.col("expected")).alias("exact"), (normalized_lines(F.col("output")) == normalized_lines(F.col("expected"))).alias("normalized"), markers.alias("markers"), F.sha2("output", 256).alias("sha256"))


#: run_scorecard's percentile sketches err by a row in so many; the true value is looked for within ten such errors.
SKETCH = 10_000


def run_scorecard(results: DataFrame) -> DataFrame:
    """results (extension, repository, status, seconds, markers, exact) by extension, by repository and over all:
    cases, applied, clean, exact, safety, p50, p95, throughput.

    p50 and p95 are exact: the least value that so large a part of the values does not exceed. Sketches say between which values
    they lie; equal values are counted, and only those between are put in order (all of a group's, should its sketch be wrong)."""
    applied = F.col("status") == "completed"
    clean = applied & ~F.col("markers")
    near = F.array(*[F.lit(min(1.0, h / 100 + side * 10 / SKETCH)) for h in (50, 95) for side in (-1, 1)])
    key = lambda g: F.struct(g.alias("dimension"), "extension", "repository").alias("key")
    dimension = lambda extension, repository: F.when(F.col("g") == extension, "extension").when(F.col("g") == repository, "repository").otherwise("all")
    sets = results.groupingSets([["extension"], ["repository"], []], "extension", "repository").agg(
        F.count("*").alias("cases"), F.count_if(applied).alias("applied"), F.count_if(clean).alias("clean"), F.count_if(clean & F.col("exact")).alias("exact"),
        F.count("seconds").alias("timed"), F.percentile_approx("seconds", near, SKETCH).alias("near"), F.sum("seconds").alias("seconds"), F.grouping_id().alias("g"),
    )
    sets = written(sets.select(key(dimension(1, 2)), "*").drop("extension", "repository", "g"), "scorecard-sets")
    counts = results.where("seconds IS NOT NULL").groupingSets([["extension", "seconds"], ["repository", "seconds"], ["seconds"]], "extension", "repository", "seconds").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    counts = written(counts.select(key(dimension(2, 4)), "seconds", "n"), "scorecard-counts")
    ranges = F.inline(F.array(*[F.struct(F.lit(h).alias("hundredths"), F.col("near")[2 * k].alias("low"), F.col("near")[2 * k + 1].alias("high")) for k, h in enumerate((50, 95))]))
    ranges = sets.select("key", "timed", ranges).withColumn("target", F.expr("(hundredths * timed + 99) div 100"))
    upto = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    sums = counts.join(ranges, "key").groupBy("key", "hundredths", "low", "high", "target").agg(upto(F.col("seconds") < F.col("low")).alias("below"), upto(F.col("seconds") <= F.col("high")).alias("within"))
    holds = F.expr("below < target AND target <= within")
    sums = sums.select("key", "hundredths", "target", *[F.when(holds, F.col(c)).alias(c) for c in ("low", "high", "below")])
    between = counts.join(sums, "key").where("low IS NULL OR seconds BETWEEN low AND high")
    w = Window.partitionBy("key", "hundredths").orderBy("seconds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = between.withColumn("reached", F.coalesce("below", F.lit(0)) + F.sum("n").over(w)).where("reached >= target")
    found = reached.groupBy("key").agg(*[F.min(F.when(F.col("hundredths") == h, F.col("seconds"))).alias(f"p{h}") for h in (50, 95)])
    return sets.join(found, "key", "left").select("key.dimension", F.coalesce("key.extension", "key.repository", F.lit("all")).alias("value"), "cases", "applied", "clean", "exact", F.try_divide(F.col("exact"), F.col("clean")).alias("safety"), "p50", "p95", F.try_divide(F.col("cases"), F.col("seconds")).alias("throughput"))


def promotion_status(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """metrics per provider under a policy (family, min_fixtures, max_fallbacks, max_conflicts): reasons and status."""
    rows = metrics.join(policy, "family", "left")
    tests = {
        "hard_gate": ~F.col("hard_gate_passed"), "fixture_count": F.col("fixtures") < F.coalesce("min_fixtures", F.lit(1)), "formatting": ~F.col("formatting_preserved"),
        "fallbacks": F.col("fallbacks") > F.coalesce("max_fallbacks", F.lit(0)), "conflicts": F.col("conflicts") > F.coalesce("max_conflicts", F.lit(0)), "parity": ~F.col("parity"),
    }
    rows = rows.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])))
    hard = F.array_contains("reasons", "hard_gate") | F.array_contains("reasons", "fixture_count")
    status = F.when(hard, "experimental").when(F.size("reasons") > 0, "available").otherwise("recommended")
    return rows.select("provider", "family", F.array_join("reasons", ",").alias("reasons"), status.alias("status"))


def meets_status(status: Column, minimum: Column) -> Column:
    rank = lambda c: F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[c]
    return rank(status) >= rank(minimum)


def review_groups(cases: DataFrame, resolved: DataFrame, accepted: DataFrame) -> DataFrame:
    """cases (group_id, case_id), resolved (case_id), accepted (group_id): progress, ready and accepted per group."""
    done = resolved.select("case_id").distinct().withColumn("done", F.lit(True))
    groups = cases.join(done, "case_id", "left").groupBy("group_id").agg(F.count("*").alias("cases"), F.count_if(F.col("done")).alias("resolved"))
    yes = accepted.select("group_id").distinct().withColumn("accepted", F.lit(True))
    return groups.join(yes, "group_id", "left").select("group_id", "cases", "resolved", (F.col("cases") == F.col("resolved")).alias("ready"), (F.coalesce("accepted", F.lit(False)) & (F.col("cases") == F.col("resolved"))).alias("applied"))


def pair_results(results: DataFrame, base: str, candidate: str) -> DataFrame:
    """Results of two adapters side by side for each case of a run; a case with one side only is a violation."""
    side = lambda a, n: results.where(F.col("adapter_id") == a).select("run_id", "case_id", F.col("outcome").alias(n))
    both = side(base, "base_outcome").join(side(candidate, "candidate_outcome"), ["run_id", "case_id"], "full_outer")
    violation = F.when(F.col("base_outcome").isNull() | F.col("candidate_outcome").isNull(), "dangling_pair")
    return both.withColumn("violation", violation)


def check_references(cases: DataFrame, results: DataFrame) -> DataFrame:
    """id and violation: case ids that stand twice, results of unknown cases, cases without a result."""
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("case_id").alias("id"), F.lit("duplicate_case").alias("violation"))
    dangling = results.join(cases, "case_id", "left_anti").select(F.col("case_id").alias("id"), F.lit("dangling_case").alias("violation")).distinct()
    missing = cases.join(results, "case_id", "left_anti").select(F.col("case_id").alias("id"), F.lit("missing_result").alias("violation")).distinct()
    return twice.unionByName(dangling).unionByName(missing)


def check_benchmark(cases: DataFrame, runs: DataFrame, adapters: DataFrame, selections: DataFrame, results: DataFrame, reported: DataFrame) -> DataFrame:
    """The references between tables of benchmark runs -> run_id, id, violation, n (rows at fault).

    cases: case_id, operation, parent_case_id; runs: run_id; adapters: run_id, adapter_id; selections: run_id, case_id, side (selected or
    excluded); results: run_id, result_id, case_id, adapter_id; reported: run_id, result_id.

    A case that is metamorphic has a parent among the cases (dangling_parent). In a run no case is selected twice or excluded twice
    (duplicate_selected, duplicate_excluded) or both (overlap), and both name cases (dangling_selection). Results name a run
    (dangling_run, id null), one of its adapters (dangling_adapter) and a case (dangling_result_case). A run's report names each result
    once and no other (duplicate_result, duplicate_reported, unreported, unknown_reported). A null reference is a dangling one.

    Rows are counted by what they name before they meet it, so a run with most of the rows is one small row at the joins."""
    text = lambda c: F.col(c).cast("string")
    told = lambda df, name, run, id_, n: df.select(run.alias("run_id"), id_.alias("id"), F.lit(name).alias("violation"), n.cast("long").alias("n"))
    none = F.lit(None).cast("string")

    def lacking(named: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
        return named.join(known.select(*columns).distinct(), columns, "left_anti")

    def several(pairs: DataFrame, id_: str, tests: dict) -> DataFrame:
        """A row for each violation that a counted pair shows; tests: name -> (condition, number of rows)."""
        found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("violation"), n.cast("long").alias("n"))) for name, (test, n) in tests.items()]))
        return pairs.select(text("run_id").alias("run_id"), text(id_).alias("id"), F.explode(found).alias("f")).select("run_id", "id", "f.violation", "f.n")

    known = cases.select("case_id")
    children = cases.where("operation = 'metamorphic'").select("case_id", F.col("parent_case_id").alias("parent"))
    orphans = lacking(children, known.select(F.col("case_id").alias("parent")), ["parent"]).groupBy("case_id").agg(F.count("*").alias("n"))
    side = lambda s: F.count_if(F.col("side") == s).alias(s)
    chosen = selections.groupBy("run_id", "case_id").agg(side("selected"), side("excluded"), F.count("*").alias("n"))
    s, x = F.col("selected"), F.col("excluded")
    choices = several(chosen, "case_id", {"duplicate_selected": (s > 1, s), "duplicate_excluded": (x > 1, x), "overlap": ((s > 0) & (x > 0), s + x)})
    both = results.select("run_id", "result_id", F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(reported.select("run_id", "result_id", F.lit(0).alias("r"), F.lit(1).alias("p")))
    r, p = F.col("r"), F.col("p")
    covered = several(both.groupBy("run_id", "result_id").agg(F.sum("r").alias("r"), F.sum("p").alias("p")), "result_id", {"duplicate_result": (r > 1, r), "duplicate_reported": (p > 1, p), "unreported": (p == 0, r), "unknown_reported": (r == 0, p)})
    of_run = results.groupBy("run_id", "adapter_id").agg(F.count("*").alias("n"))
    of_case = results.groupBy("run_id", "case_id").agg(F.count("*").alias("n"))
    lost = lacking(of_run, runs, ["run_id"]).groupBy("run_id").agg(F.sum("n").alias("n"))
    return (
        told(orphans, "dangling_parent", none, text("case_id"), F.col("n")).unionByName(choices).unionByName(told(lacking(chosen, known, ["case_id"]), "dangling_selection", text("run_id"), text("case_id"), F.col("n")))
        .unionByName(told(lost, "dangling_run", text("run_id"), none, F.col("n"))).unionByName(told(lacking(of_run, adapters, ["run_id", "adapter_id"]), "dangling_adapter", text("run_id"), text("adapter_id"), F.col("n")))
        .unionByName(told(lacking(of_case, known, ["case_id"]), "dangling_result_case", text("run_id"), text("case_id"), F.col("n"))).unionByName(covered)
    )


def select_cases(cases: DataFrame, profiles: DataFrame) -> DataFrame:
    """cases (case_id, family, backend, dialect, policies) with messages why a family's profile cannot run them."""
    rows = cases.join(profiles, "family", "left")
    missing = F.array_except(F.coalesce("policies", F.array().cast("array<string>")), F.coalesce("known_policies", F.array().cast("array<string>")))
    reasons = F.array_compact(F.array(
        F.when(F.col("known_backends").isNull() | ~F.array_contains("known_backends", F.col("backend")), "backend"),
        F.when(F.col("dialect").isNotNull() & ~F.coalesce(F.array_contains("known_dialects", F.col("dialect")), F.lit(False)), "dialect"),
        F.when(F.size(missing) > 0, "policy"),
    ))
    return rows.select("case_id", F.array_join(reasons, ",").alias("skip_reasons"), (F.size(reasons) == 0).alias("selected"))


def assign_shards(cases: DataFrame, n: int, cost: str = "estimated_input_bytes", greedy_rows: int = GREEDY_ROWS) -> tuple[DataFrame, DataFrame]:
    """(cases with shard, loads): a repository stays together; the costliest goes first, to the shard with the
    least load (then the fewest cases, then the lowest number). A missing cost is the upper median.

    Cases are summed to repositories on Spark. The greedy order is sequential: it sees the sums of the greedy_rows
    costliest repositories, in one task of that bound. The others, each no costlier than any of those, fill what the
    shards have left up to their mean load, in order of a hash: sums by DEALT hash classes come first, so that
    running sums are windows within a class. With no more than greedy_rows repositories it is all greedy.
    """
    # The upper median: at even counts the larger of the two in the middle, the lower one of the negated values.
    median = cases.agg(F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{cost})").alias("m"))
    filled = cases.join(F.broadcast(median)).withColumn("c", F.coalesce(F.col(cost), "m", F.lit(0)).cast("double")).drop("m")
    repos = filled.groupBy("repository").agg(F.sum("c").alias("cost"), F.count("*").alias("n_cases"))

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        import heapq

        loads = [(0.0, 0, k) for k in range(n)]
        out = []
        for repo, c, k in rows.sort_values(["cost", "repository"], ascending=[False, True])[["repository", "cost", "n_cases"]].itertuples(index=False):
            load, count, shard = heapq.heappop(loads)
            out.append((repo, shard, c))
            heapq.heappush(loads, (load + c, count + k, shard))
        return pd.DataFrame(out, columns=["repository", "shard", "cost"])

    costliest = repos.orderBy(F.desc("cost"), "repository").limit(greedy_rows)
    placed = costliest.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(greedy, "repository string, shard int, cost double")
    shards = repos.sparkSession.range(n).select(F.col("id").cast("int").alias("shard"))
    rest = repos.join(costliest.select("repository"), "repository", "left_anti").withColumn("class", F.pmod(F.xxhash64("repository"), F.lit(DEALT)))
    # A shard takes the stretch of running costs that begins where those of the shards before it end.
    taken = placed.groupBy("shard").agg(F.sum("cost").alias("load"))
    total = repos.agg((F.sum("cost") / n).alias("mean"))
    free = shards.join(taken, "shard", "left").join(F.broadcast(total)).select("shard", F.greatest(F.lit(0.0), F.col("mean") - F.coalesce("load", F.lit(0.0))).alias("free"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # n rows
    begins = free.select(F.struct(F.coalesce(F.sum("free").over(upto), F.lit(0.0)).alias("at"), F.col("shard")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("begins"))
    before = Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)  # DEALT rows
    classes = rest.groupBy("class").agg(F.sum("cost").alias("cost")).select("class", F.coalesce(F.sum("cost").over(before), F.lit(0.0)).alias("class_at"))
    within = Window.partitionBy("class").orderBy("repository").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rest.join(F.broadcast(classes), "class").withColumn("at", F.col("class_at") + F.coalesce(F.sum("cost").over(within), F.lit(0.0))).join(F.broadcast(begins))
    dealt = dealt.select("repository", F.element_at(F.filter("begins", lambda b: b.at <= F.col("at")), -1).shard.alias("shard"))
    told = filled.join(placed.select("repository", "shard").unionByName(dealt), "repository")
    return told.drop("c"), told.groupBy("shard").agg(F.count("*").alias("cases"), F.sum("c").alias("load"), F.countDistinct("repository").alias("repositories"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("n = 1").drop("n")
