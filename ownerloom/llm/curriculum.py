"""Mixing sources to target weights over the course of a training.

Sizes are words. Sources in order of code points (null last) get the given weights in turn and share all words by
weight; a target stops at MOST_PASSES times its source's words and what it leaves is shared anew by weight among the
others. That level is found without rounds: sources sorted by cap over weight, sums of the caps before each and of the
weights from it on.

A source's documents stand in the order of a digest of their id and text; the place of one is the sum of the sizes
before it. Pass after pass over that order is the source's stream, and its first `target` words are the demand (the
last document is cut there). Each source has a schedule, weights at knots of the training's time from 0 to 1, linear in
between. Its integral says which share of the demand is due by a time; inverted, it gives the time at which a
document's first word is due. Documents of all sources are range-sorted by that time, and the sum of words before
each is its place in the training order.

All sums over orders go by ranges (running_totals): rows are dealt by range of the order, each range has one sum, and a
row's sum is its range's plus that within the range. A source with a third of all rows lies in a third of the ranges.

Cases: a null or empty text has size 0 and is never taken; such a source has target 0. A null source is a source of its
own, the last. Null and repeated ids keep their rows; of equal rows some may be taken more often than others, by at most
one pass. An empty table gives no rows. Of other columns only source is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownerloom.llm._common import fresh, materialize

#: Fixed value of the contract: a word.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3
#: (time, weight) at the knots of each source's schedule, given to sources in turn: falling, even, rising late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str], by: str | None = None) -> DataFrame:
    """df with, for each value column -> new column of totals, the sum of the value over all earlier rows in the order,
    of those with an equal by (null is a value). Ties in the order are broken anyhow.

    One range shuffle, written; then one of the same rows by range, where each range meets its own base.
    """
    part, keys = fresh(df, "range_part"), [by] if by else []
    spread = materialize(df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order).withColumn(part, F.spark_partition_id()), "ranges")
    sums = spread.groupBy(part, *keys).agg(*[F.sum(v).alias(f"{out}_in") for v, out in totals.items()])
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sums.select(F.col(part).alias(f"{part}_of"), *[F.col(k).alias(f"{k}_of") for k in keys], *[F.coalesce(F.sum(f"{out}_in").over(before), F.lit(0)).alias(f"{out}_base") for out in totals.values()])
    met = F.col(part) == F.col(f"{part}_of")
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(bases, met).select(*df.columns, *[(F.col(f"{out}_base") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(out) for v, out in totals.items()])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, dealt (where the document stands in its source's order) and row (a key of the row), written."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return materialize(docs.select("doc_id", source.alias("source"), size.alias("size"), F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("dealt"), F.monotonically_increasing_id().alias("row")), "mix-sizes")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """source, turn (its number in the order of sources), source_size, target: one row a source, written."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    turns = running_totals(each, [F.col("source").asc_nulls_last()], {"one": "turn"}).drop("one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    turns = turns.withColumn("weight", weight).withColumn("cap", most_passes * F.col("source_size"))
    level = F.col("cap").cast("double") / F.col("weight")
    ranked = materialize(running_totals(turns.withColumn("level", level), [F.col("level"), F.col("turn")], {"cap": "caps_before", "weight": "weights_before"}), "mix-levels")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    # At its own level all sources together would take no more than there is, so the common level lies above it.
    full = F.col("caps_before") + F.col("level") * (F.lit(whole["weight"] or 0) - F.col("weights_before")) <= F.lit(whole["words"] or 0)
    rest = ranked.agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
    common = float((whole["words"] or 0) - (rest["caps"] or 0)) / rest["weight"] if rest["weight"] else 0.0
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.lit(common) * F.col("weight"))
    return materialize(ranked.select("source", "turn", "source_size", target.alias("target")), "mix-targets")


def due_time(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time by which the share (0 to 1) of the demand is due: the inverse of the schedule's integral.

    Within a piece that begins with weight a and rises by b for a unit of time, a*x + b*x*x/2 = r gives
    x = 2*r / (a + sqrt(a*a + 2*b*r)).
    """
    times, heights = [t for t, _ in schedule], [float(w) for _, w in schedule]
    if times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(heights) < 0 or not any(heights):
        raise ValueError("a schedule has weights of 0 or more, not all 0, at rising times from 0 to 1")
    areas = [0.0]
    for (t, w), (u, v) in zip(schedule, schedule[1:], strict=False):
        areas.append(areas[-1] + (u - t) * (w + v) / 2)
    due, out = share * F.lit(areas[-1]), F.lit(float(times[0]))
    for k in range(len(times) - 1):
        if areas[k + 1] == areas[k]:
            continue
        rest, a, b = due - F.lit(areas[k]), heights[k], (heights[k + 1] - heights[k]) / (times[k + 1] - times[k])
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * b) * rest))
        out = F.when(rest > 0, F.lit(float(times[k])) + F.lit(2.0) * rest / (F.lit(a) + root)).otherwise(out)
    return out


def curriculum(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_passes: int = MOST_PASSES, schedules: tuple = SCHEDULES) -> DataFrame:
    """The training order: one row for each time a document is taken, range-sorted by position.

    row (a key of the document's row), doc_id, source, size, source_size, target (words, of its source), pass (from 0),
    words (those taken, fewer than size only where the demand ends), position (time from 0 to 1), first_word (words of
    the training before it). A document that is never taken has one row without pass and position, and words 0.
    """
    sizes = sized(docs)
    targets = source_targets(sizes, weights, most_passes)
    placed = running_totals(sizes, [F.col("dealt"), F.col("doc_id"), F.col("size")], {"size": "begin"}, by="source")
    named = targets.withColumnRenamed("source", "source_of")
    mixed = placed.join(named, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")
    demand = F.floor(F.col("target") + 0.5)
    start = F.col("begin") + F.coalesce(F.col("pass"), F.lit(0)) * F.col("source_size")
    passes = F.array(*[F.struct(F.lit(k).alias("pass")) for k in range(most_passes)])
    words = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), demand - F.col("begin") - p["pass"] * F.col("source_size")))
    taken = F.filter(passes, lambda p: words(p) > 0)
    each = mixed.withColumn("taken", taken).select("*", F.inline_outer("taken")).drop("taken")
    each = each.withColumn("start", start).withColumn("words", F.when(F.col("pass").isNull(), F.lit(0)).otherwise(F.least(F.col("size"), demand - F.col("start"))))
    share, position = F.col("start").cast("double") / demand.cast("double"), F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        position = F.when(F.col("turn") % len(schedules) == k, due_time(share, schedule)).otherwise(position)
    each = each.withColumn("position", F.when(F.col("pass").isNotNull(), position))
    ordered = running_totals(each, [F.col("position").asc_nulls_last(), F.col("turn"), F.col("start"), F.col("row")], {"words": "first_word"})
    first_word = F.when(F.col("pass").isNotNull(), F.col("first_word"))
    return ordered.select("row", "doc_id", "source", "size", "source_size", "target", "pass", "words", "position", first_word.alias("first_word"))


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: what the training order takes of each document, and where it first does."""
    order = curriculum(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = order.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("words").alias("taken"), F.min("first_word").alias("first_word"))
    return each.select("doc_id", "size", "source_size", "target", "taken", "first_word")


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS dealt
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source
), w AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS level, sum(source_size) OVER () AS words, sum(weight) OVER () AS all_weight FROM w
), f AS (
  SELECT *, coalesce(sum(cap) OVER q, 0) + level * (all_weight - coalesce(sum(weight) OVER q, 0)) <= words AS is_full
  FROM l WINDOW q AS (ORDER BY level, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, turn, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    (CAST(words - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS DOUBLE) / sum(weight) FILTER (NOT is_full) OVER ()) * weight END AS target
  FROM f
), p AS (
  SELECT d.*, t.turn, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY t.turn ORDER BY d.dealt, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT p.*, k.k, begin + k.k * source_size AS start, greatest(0, least(size, demand - begin - k.k * source_size)) AS words
  FROM p, (VALUES (0), (1), (2)) AS k(k)
), x AS (
  SELECT *, CAST(start AS DOUBLE) / CAST(demand AS DOUBLE) AS share FROM e WHERE words > 0
), o AS (
  SELECT *, CASE turn % 3
    WHEN 0 THEN CASE WHEN share > 0 THEN 2e0 * share / (1.5e0 + sqrt(greatest(0e0, 2.25e0 + -2e0 * share))) ELSE 0e0 END
    WHEN 1 THEN share
    ELSE CASE WHEN share - 0.25e0 > 0 THEN 0.5e0 + 2e0 * (share - 0.25e0) / (0.75e0 + sqrt(0.5625e0 + 6e0 * (share - 0.25e0)))
              WHEN share > 0 THEN 2e0 * share / (0.25e0 + sqrt(0.0625e0 + 2e0 * share)) ELSE 0e0 END END AS position
  FROM x
), n AS (
  SELECT r, words, coalesce(sum(words) OVER (ORDER BY position, turn, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word FROM o
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(sum(n.words), 0) AS BIGINT) AS taken, CAST(min(n.first_word) AS BIGINT) AS first_word
FROM p LEFT JOIN n ON p.r = n.r GROUP BY p.r, p.doc_id, p.size, p.source_size, p.target
"""
