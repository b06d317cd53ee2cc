"""Ranked lexical search of documents for a set of items, by classes of equal bags.

A document is cut down to the terms that some item has: its bag, pairs of term number and count, and the number n of all
its terms. In place over the scan each task already joins documents with equal bag and n to one row with their number
and their `top` smallest ids, so a group of copies sends one row a task. From these rows come the statistics over all
documents (how many have a term, how many terms, how many hold each term of the vocabulary) and, once these give each n
its m, the classes of equal bag and m: grouped by a hash of the bag and verified by the whole bag and m. A class is scored
once, with 64-bit integers; its members are expanded by ascending doc_id, and as they share a score only
the `top` smallest can be among the best. Tasks keep the best rows of each item and pass only these on.

Items go in blocks by a hash of their row, so that a block's vocabulary and item terms stay below BLOCK_TERMS; that bounds what
a worker and the driver hold. Every block reads all documents; the results do not depend on blocks.

Cases: a document without a term (null, empty or separators only) counts nowhere and is never found. Items without a term, or whose
terms no document holds, give no rows. Repeated item ids are items of their own, each with its rows. Null doc_ids come after all
others with an equal score; repeated ones are rows of their own. Texts of any length are read whole. An empty table on either
side gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownerloom.llm._common import discard, materialize, small_batches

TOP = 10
#: Item terms (distinct in their item) in one block.
BLOCK_TERMS = 500_000
#: Bytes of bags that a task holds before it gives them out.
HELD_BYTES = 16 << 20
#: Scores in one matrix of classes and items.
MATRIX = 2_000_000
_NO_ID = np.iinfo(np.int64).max
#: Fixed values of the contract: bytes of letters, digits and beyond ASCII belong to terms, A-Z in lower case; all others part them.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_TERM_BYTES).split()


def _utf8(column: str):
    return F.encode(F.col(column).cast("string"), "utf-8")


def item_terms(items: DataFrame) -> DataFrame:
    """item (a key of the row), item_id, term (UTF-8), repeats: the terms of each item, written."""
    schema = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.binary()), ("repeats", pa.int64())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, item_id, term, k) for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text for term, k in Counter(terms(text)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    texts = items.select(F.monotonically_increasing_id(), F.col("item_id").cast("long"), _utf8("text"))
    with small_batches(items.sparkSession):
        return materialize(texts.mapInArrow(cut, "item long, item_id long, term binary, repeats long"), "search-items")


def bags(docs: DataFrame, vocabulary: list[bytes], top: int = TOP) -> DataFrame:
    """n, term_ids and counts (both by rising term number), copies, ids: one row for each task and bag, or more where a
    task has given out its rows before; over all documents with a term. Written."""
    schema = pa.schema([("n", pa.int64()), ("term_ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("copies", pa.int64()), ("ids", pa.list_(pa.int64()))])
    told = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by BLOCK_TERMS

    def out(held: dict[tuple[int, bytes], list]) -> Iterator[pa.RecordBatch]:
        listed = list(held.items())
        for at in range(0, len(listed), 1000):
            part = listed[at : at + 1000]
            pairs = [np.frombuffer(bag, "<i4").reshape(2, -1) for (_, bag), _ in part]
            bounds = np.concatenate(([0], np.cumsum([p.shape[1] for p in pairs]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([p[k] for p in pairs]), pa.int32())) for k in (0, 1)]
            ids = [[None if i == _NO_ID else i for i in heapq.nsmallest(top, found[1])] for _, found in part]
            yield pa.RecordBatch.from_arrays([pa.array([n for (n, _), _ in part], pa.int64()), *lists, pa.array([found[0] for _, found in part], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], schema=schema)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {term: k for k, term in enumerate(told.value)}
        held: dict[tuple[int, bytes], list] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = terms(text.as_py() or b"")
                if not found:
                    continue
                tf = sorted((numbers[t], k) for t, k in Counter(found).items() if t in numbers)
                key = (len(found), np.array(tf, "<i4").reshape(-1, 2).T.tobytes())
                if key not in held:
                    held[key] = [0, []]
                    size += len(key[1]) + 400
                entry = held[key]
                entry[0] += 1
                entry[1].append(_NO_ID if doc_id is None else doc_id)
                if len(entry[1]) > 64:
                    entry[1] = heapq.nsmallest(top, entry[1])
                if size >= HELD_BYTES:
                    yield from out(held)
                    held, size = {}, 0
        yield from out(held)

    with small_batches(docs.sparkSession):
        return materialize(docs.select(F.col("doc_id").cast("long"), _utf8("text")).mapInArrow(gather, "n long, term_ids array<int>, counts array<int>, copies long, ids array<long>"), "search-bags")


def classes(found: DataFrame, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """m, term_ids, counts, ids: one row for each class of documents with equal bag and m; ids are its `top` smallest, nulls last."""
    m = (F.lit(100 - 75) + F.expr(f"(75 * n * {n_docs}L) div {n_terms}L")).alias("m")
    keyed = found.where(F.size("term_ids") > 0).select(F.xxhash64("term_ids", "counts").alias("hash"), m, "term_ids", "counts", "ids")
    # The hash leads, so that whole bags are compared only where hashes are equal.
    return keyed.groupBy("hash", "m", "term_ids", "counts").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, top).alias("ids")).drop("hash")


def score_classes(found: DataFrame, weights: list[int], listed: list[tuple[int, int, int]], item_ids: list[int | None], top: int = TOP) -> DataFrame:
    """item (its place in item_ids), item_id, doc_id, score: the best rows of each item from each task.

    weights: of the terms by number. listed: (term number, item, repeats), ordered by term.
    """
    starts = np.searchsorted(np.array([t for t, _, _ in listed], np.int64), np.arange(len(weights) + 1))
    told = found.sparkSession.sparkContext.broadcast((starts, np.array([i for _, i, _ in listed], np.int64), np.array([k * weights[t] for t, _, k in listed], np.int64)))  # bounded by BLOCK_TERMS
    n_items = len(item_ids)
    schema = pa.schema([("item", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def scored(part: pa.RecordBatch) -> np.ndarray:
        starts, items, gains = told.value
        m, sizes = part.column(0).to_numpy(), part.column(1).value_lengths().to_numpy()
        term, tf = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(m)), sizes)
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
        spans = starts[term + 1] - starts[term]
        at = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(starts[term], spans)
        scores = np.zeros(len(m) * n_items, np.int64)
        np.add.at(scores, np.repeat(row, spans) * n_items + items[at], gains[at] * np.repeat(gain, spans))
        return scores.reshape(len(m), n_items)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((3, 0), np.int64)  # item, score, doc_id of the best rows so far, in order
        least = np.ones(n_items, np.int64)  # a row below it can not be among an item's best
        step = max(1, MATRIX // max(1, n_items))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                scores = scored(part)
                if len(scores) > top:
                    least = np.maximum(least, np.partition(scores, len(scores) - top, axis=0)[len(scores) - top])
                row, item = np.nonzero(scores >= least)
                if not len(row):
                    continue
                ids = part.column(3)
                flat, sizes = ids.flatten().fill_null(_NO_ID).to_numpy(zero_copy_only=False), ids.value_lengths().to_numpy()
                first, many = (np.cumsum(sizes) - sizes)[row], sizes[row]
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                more = np.stack([np.repeat(item, many), np.repeat(scores[row, item], many), flat[at]])
                kept = np.concatenate([kept, more], axis=1)
                kept = kept[:, np.lexsort((kept[2], -kept[1], kept[0]))]
                begins = np.searchsorted(kept[0], np.arange(n_items + 1))
                kept = kept[:, np.arange(kept.shape[1]) - begins[kept[0]] < top]
                begins = np.searchsorted(kept[0], np.arange(n_items + 1))
                full = begins[1:] - begins[:-1] == top
                least[full] = np.maximum(least[full], kept[1, begins[1:][full] - 1])
        if kept.shape[1]:
            ids = pa.array(kept[2], mask=kept[2] == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array([item_ids[k] for k in kept[0]], pa.int64()), ids, pa.array(kept[1])], schema=schema)

    return found.select("m", "term_ids", "counts", "ids").mapInArrow(best, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item, by falling score and rising doc_id."""
    spark = docs.sparkSession
    asked = item_terms(items)
    blocks = max(1, -(-asked.count() // block_terms))
    out = None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        vocabulary = [bytes(r[0]) for r in block.select("term").distinct().collect()]  # bounded by block_terms
        if not vocabulary:
            continue
        numbers = {t: i for i, t in enumerate(vocabulary)}
        found = bags(docs, vocabulary, top)
        held = found.agg(F.sum("copies").alias("docs"), F.sum(F.col("copies") * F.col("n")).alias("terms")).first()
        if not held["docs"]:
            continue
        df = {r[0]: r[1] for r in found.select(F.explode("term_ids").alias("t"), "copies").groupBy("t").agg(F.sum("copies")).collect()}  # one row a term
        weights = [math.floor(1000 * math.log((2 * held["docs"] + 2) / (2 * df[i] + 1))) if i in df else 0 for i in range(len(vocabulary))]
        places: dict[int, int] = {}
        item_ids, listed = [], []
        for r in block.select("item", "item_id", "term", "repeats").collect():  # bounded by block_terms
            if r["item"] not in places:
                places[r["item"]] = len(item_ids)
                item_ids.append(r["item_id"])
            listed.append((numbers[bytes(r["term"])], places[r["item"]], r["repeats"]))
        best = score_classes(classes(found, held["docs"], held["terms"], top), weights, sorted(listed), item_ids, top)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        best = materialize(best.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), "search-best")
        discard(found)
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), c AS (
  SELECT count(*) AS n_docs, sum(len(t)) AS n_terms FROM d WHERE len(t) > 0
), i AS (
  SELECT item, item_id, term, count(*) AS repeats FROM (
    SELECT row_number() OVER () AS item, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs
), s AS (
  SELECT i.item, i.item_id, p.r, p.doc_id, CAST(sum(i.repeats * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * c.n_docs) // c.n_terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY i.item, i.item_id, p.r, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
