"""Packing token pieces into sequences of one window, planned by non-negative least squares.

1. Each document is encoded once, in place (no shuffle), and written with its number of tokens.
   Whole windows of it are full sequences; what is left is its tail (1 to window - 1 tokens).
2. The tails' histogram (at most window - 1 numbers, however large the input) goes to the driver.
   There combinations of one to four lengths that fill a window exactly are enumerated, their
   repeat counts are solved against the histogram by non-negative least squares, and rounded down
   to what the histogram holds. The rest is packed greedily by length: the longest first, then the
   longest that still fits; where nothing fits, a piece is cut to fill the gap. So every sequence is
   full but the last. All this works on runs of equal lengths and so does not grow with the input.
3. A tail's rank among those of its length gives its place in the plan. Ranks come from counts by
   task and length, summed before each task, so a length that a third of the documents share is
   still ranked in every task on its own. The encoded documents are bucketed by task, and a task's
   sums are one row of at most window numbers; they meet by shuffling the sums. Ids are neither
   shuffled nor broadcast with anything that grows.

Cases: null text is empty (only the end id). Null and repeated doc_ids are documents of their own; texts of any
length are encoded whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownerloom.llm._common import give_back, materialize, materialize_by, small_batches, worker_keeps
from ownerloom.llm.encoding import encoder, vocabulary_path

WINDOW = 2048
ENCODED = "doc_id long, ids binary, n_tokens long, task long, full_rank long, tail_rank long"
#: Rows and bytes of ids in one batch that a task gives out.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Buckets of encoded documents for each task that encodes; bucket numbers are hashes of task numbers.
BUCKETS_A_TASK, MOST_BUCKETS = 4, 100_000
#: Combinations of more than two lengths that are tried for each longest length.
MIDDLES = 12
SWEEPS = 400


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, the end id last), n_tokens; task, and within the
    task: full_rank (full windows before this document's) and tail_rank (tails of this length before it)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("task", pa.int64()), ("full_rank", pa.int64()), ("tail_rank", pa.int64())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, enc, end = TaskContext.get().partitionId(), encoder(vocabulary_path(vocabulary)), np.array([end_id], "<u4").tobytes()
        fulls, tails = 0, [0] * window

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = enc.encode(text.as_py()) + end
                n = len(packed) // 4
                tail = n % window
                rows.append((doc_id, packed, n, task, fulls, tails[tail]))
                fulls += n // window
                tails[tail] += 1
                size += len(packed)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield given(rows)
                    rows, size = [], 0
            if rows:
                yield given(rows)
            rows = batch = None
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, ENCODED)


def combinations(present: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Shallow combinations of present lengths that fill the window exactly."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    out: set[tuple[int, ...]] = set()
    lengths = np.sort(present)
    for a in lengths[::-1].tolist():
        rest = window - a
        if rest <= a and rest > 0 and has[rest]:
            out.add((a, rest))
        below = lengths[(lengths <= a) & (lengths < rest)]
        for b in below[np.unique(np.linspace(0, len(below) - 1, MIDDLES).astype(int))].tolist() if len(below) else []:
            c = rest - b
            if 0 < c <= b and has[c]:
                out.add((a, b, c))
            if 0 < c <= 2 * b and c % 2 == 0 and has[c // 2]:
                out.add((a, *sorted((b, c // 2, c // 2), reverse=True)))
    return sorted({tuple(sorted(c, reverse=True)) for c in out})


def repeat_counts(combos: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """min |A x - h| over x >= 0 by accelerated projected gradient; A's columns count the lengths of a combination."""
    if not combos:
        return np.zeros(0)
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.concatenate([np.array(c) for c in combos])
    times = lambda x: np.bincount(row, x[column], len(histogram))
    back = lambda r: np.bincount(column, r[row], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(times(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(SWEEPS):
        new = np.maximum(0, y - step * back(times(y) - histogram))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


class Plan:
    """Places of tails: for each length, ranges of ranks, each with its places.

    A place is (first rank, start in the tail, length, sequence of the first rank, offset): the tail
    of rank r has it in sequence + r - first rank.
    """

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.sequences = window, 0
        self.places: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        used, left = np.zeros(window, np.int64), histogram.astype(np.int64).copy()
        combos = combinations(np.flatnonzero(histogram), window)
        counts = repeat_counts(combos, histogram.astype(float))
        for k in np.argsort(-counts, kind="stable").tolist():
            if counts[k] < 0.5:
                break
            need = np.bincount(combos[k], minlength=window)
            at = np.flatnonzero(need)
            n = min(round(counts[k]), int((left[at] // need[at]).min()))
            if n <= 0:
                continue
            offset = 0
            for length in combos[k]:
                self._put(length, int(used[length]), n, 0, length, offset)
                used[length] += n
                left[length] -= n
                offset += length
            self.sequences += n
        self._greedy(used, left)

    def _put(self, tail: int, rank: int, n: int, start: int, length: int, offset: int) -> None:
        self.places.setdefault(tail, []).append((rank, rank + n, start, length, self.sequences, offset))

    def _greedy(self, used: np.ndarray, left: np.ndarray) -> None:
        """Runs are (length, tail, first rank, count, start in the tail), kept by length."""
        runs = [(int(x), int(x), int(used[x]), int(left[x]), 0) for x in np.flatnonzero(left)]
        runs.sort()
        while runs:
            picks, gap, pool = [], self.window, list(runs)
            while gap and pool:
                k = bisect.bisect_right(pool, (gap, *[1 << 62] * 4)) - 1
                cut = k < 0
                k = 0 if cut else k
                length, tail, rank, count, start = pool.pop(k)
                # One item of the run is reserved; if it fits again the same run is picked again.
                same = sum(1 for p in picks if p[1:3] == (tail, rank) and p[4] == start)
                if count > same + 1:
                    bisect.insort(pool, (length, tail, rank, count, start))
                picks.append((length, tail, rank, count, start, min(gap, length)))
                gap -= min(gap, length)
            times: dict[tuple, int] = {}
            for p in picks:
                times[p[:5]] = times.get(p[:5], 0) + 1
            n = min(count // times[p] for p in times for count in (p[3],))
            offset, pieces = 0, []
            rank_of = {p: p[2] for p in times}
            for length, tail, rank, count, start, part in picks:
                key = (length, tail, rank, count, start)
                self._put(tail, rank_of[key], n, start, part, offset)
                if part < length:
                    pieces.append((length - part, tail, rank_of[key], n, start + part))
                rank_of[key] += n
                offset += part
            for key in times:
                runs.pop(bisect.bisect_left(runs, key))
                length, tail, rank, count, start = key
                if rest := count - (rank_of[key] - rank):
                    bisect.insort(runs, (length, tail, rank_of[key], rest, start))
            for piece in pieces:
                bisect.insort(runs, piece)
            self.sequences += n

    def table(self) -> dict[int, tuple[np.ndarray, list[list[tuple]]]]:
        """For each tail length: breaks of the ranks, and the places of each range between them."""
        out = {}
        for tail, places in self.places.items():
            breaks = sorted({x for p in places for x in p[:2]})
            ranges: list[list[tuple]] = [[] for _ in breaks]
            for p in places:
                for k in range(bisect.bisect_left(breaks, p[0]), bisect.bisect_left(breaks, p[1])):
                    ranges[k].append((p[0], *p[2:]))
            out[tail] = (np.array(breaks), ranges)
        return out


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (packed binary), doc_tokens, sequence_id, offset."""
    spark, given = docs.sparkSession, encode_documents(docs, vocabulary, end_id, window)
    buckets = min(MOST_BUCKETS, max(1, BUCKETS_A_TASK * given.rdd.getNumPartitions()))
    with small_batches(spark):
        encoded = materialize_by(given, "pack-ids", "task", buckets)
    per_doc = encoded.select("task", F.expr(f"n_tokens div {window}").alias("fulls"), F.expr(f"cast(n_tokens % {window} as int)").alias("tail"))
    # Slot 0 counts whole windows, the others tails of their length.
    slots = F.expr("array(named_struct('slot', 0, 'k', fulls), named_struct('slot', tail, 'k', if(tail > 0, 1L, 0L)))")
    counts = per_doc.select("task", F.inline(slots)).groupBy("task", "slot").agg(F.sum("k").alias("n"))
    counts = materialize(counts, "pack-counts")
    histogram = np.zeros(window, np.int64)
    for slot, n in counts.groupBy("slot").agg(F.sum("n")).collect():  # at most window rows
        histogram[slot] = n
    n_full, histogram[0] = int(histogram[0]), 0
    plan = Plan(histogram, window)
    table, n_tail = plan.table(), plan.sequences

    before = Window.partitionBy("slot").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.repartition(buckets, "task").groupBy("task").agg(F.map_from_entries(F.collect_list(F.struct("slot", "base"))).alias("base"))

    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "sequence_id", "offset")]))

    def find(tails: pa.Array, ranks: pa.Array) -> pa.Array:
        worker_keeps("places")  # nothing; all documents are encoded, so the encoder goes
        out = []
        for tail, rank in zip(tails.to_pylist(), ranks.to_pylist(), strict=True):
            if not tail:
                out.append([])
                continue
            breaks, ranges = table[tail]
            found = ranges[int(np.searchsorted(breaks, rank, "right")) - 1]
            out.append([{"start": p[1], "length": p[2], "sequence_id": n_full + p[3] + rank - p[0], "offset": p[4]} for p in found])
        return pa.array(out, kind)

    find.__annotations__ = {"tails": pa.Array, "ranks": pa.Array, "return": pa.Array}
    places = F.arrow_udf(find, "array<struct<start:long,length:long,sequence_id:long,offset:long>>")

    # A task's sums are wide; each row takes its two numbers from them before it waits for Python.
    tail = F.expr(f"cast(n_tokens % {window} as int)")
    joined = encoded.join(bases.hint("shuffle_hash"), "task")
    placed = joined.select("doc_id", "ids", "n_tokens", tail.alias("tail"), (F.expr("base")[tail] + F.col("tail_rank")).alias("tail_at"), (F.expr("base[0]") + F.col("full_rank")).alias("full_at"))
    placed = placed.withColumn("whole", F.expr(f"n_tokens div {window}")).withColumn("tails", places("tail", "tail_at"))
    whole = F.expr(f"transform(if(whole > 0, sequence(0L, whole - 1), array()), j -> named_struct('start', j * {window}L, 'length', {window}L, 'sequence_id', full_at + j, 'offset', 0L))")
    rest = F.expr(f"transform(tails, t -> named_struct('start', t.start + whole * {window}L, 'length', t.length, 'sequence_id', t.sequence_id, 'offset', t.offset))")
    pieces = placed.select("doc_id", "ids", F.col("n_tokens").alias("doc_tokens"), F.explode(F.concat(whole, rest)).alias("piece"))
    return pieces.select("doc_id", "piece.start", "piece.length", F.expr("substring(ids, cast(piece.start * 4 + 1 as int), cast(piece.length * 4 as int))").alias("ids"), "doc_tokens", "piece.sequence_id", "piece.offset")


def packed_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document, window 2048."""
    return packed_digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
