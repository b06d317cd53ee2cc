"""Connected components of a graph given as pairs, by repeated joins; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ownerloom.llm._common import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a, b of one orderable type) -> (node, component): the smallest node that each node reaches.

    Alternates two steps until nothing changes (large-star, small-star): every node points its
    larger neighbours, then its smaller ones and itself, at the smallest node near it. A group of n
    nodes takes about log n rounds; each round is two joins on the node with a map-side minimum, so
    a node with very many neighbours is a join key that Spark can split, not a list in a task.
    Null ends and loops are ignored; no edges give no rows.
    """
    ends = edges.select("a", "b").where("a <> b")
    pairs = materialize(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-0")

    def digest(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        return tuple(row)

    seen = digest(pairs)
    for k in range(max_rounds):
        if not seen[0]:
            break
        # Large star: around each node, larger neighbours go to the smallest of the node and its neighbours.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: around each node, its smaller neighbours and itself go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        before, pairs = pairs, materialize(small, f"cc-{k + 1}")
        discard(before)
        now = digest(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
