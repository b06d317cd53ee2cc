"""Acceptance of observations as they come, with keyed state, and merges that resume where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ownerloom.operators.ingest import DECISION, OBSERVED, SCOPE, Acceptance, fold_rows
from ownerloom.sources.corpus import pending_cases

STATE = "head string, seen map<string,string>, decisions map<string,string>, revisions map<string,string>"


def accept_observation_stream(observations: DataFrame, expire_after_ms: int | None = None) -> DataFrame:
    """The same fold over a stream, with the state kept per producer and scope.

    A scope's state grows with its observations. With expire_after_ms the state of a scope that has had none for so long
    (processing time) is dropped; a later one of the scope then begins a new chain."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get if state.exists else (None, {}, {}, {})
        folded = Acceptance(kept[0], *(dict(x or {}) for x in kept[1:]))
        rows = pd.concat(list(batches))
        out = fold_rows(folded, rows, key)
        state.update((folded.head, folded.seen, folded.decisions, folded.revisions))
        if expire_after_ms is not None:
            state.setTimeoutDuration(expire_after_ms)
        yield out

    timeout = "NoTimeout" if expire_after_ms is None else "ProcessingTimeTimeout"
    return observations.select(*OBSERVED).groupBy(*SCOPE).applyInPandasWithState(fold, DECISION, STATE, "append", timeout)


def incremental_merge(cases: DataFrame, merge: Callable[[DataFrame], DataFrame], results: str, checkpoint: str):
    """Start a stream of cases whose results are written once: each batch takes only cases without a result."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates(["case_id"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(results)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            todo = pending_cases(todo, spark.read.parquet(results))
        merge(todo).write.mode("append").parquet(results)

    return cases.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
