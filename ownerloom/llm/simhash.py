"""SimHash near-duplicates through an embedding of fingerprints as segment bit counts.

A fingerprint is cut into segments, and each segment is mapped to its number of set bits. The
Manhattan distance of two such vectors is never more than the fingerprints' Hamming distance, so
all links at 2 or fewer differing bits lie among vectors at distance 2 or less. These are found by
a grid: every distinct fingerprint is entered in the cell of its vector and in the cells one step
from it, and two vectors at distance 2 or less then share a cell. Pairs in a cell are verified on
the fingerprints themselves.

A cell with more than CELL fingerprints is not paired up. Its fingerprints are entered again in the
finest grid, segments of one bit, where the vector is the fingerprint: two that share a cell there
are at most 2 bits apart, and so a cell's members are linked to its smallest without forming pairs.
Every link is thus found at any size of group, and no group gives a number of rows that grows with
its square. Copies are one fingerprint from the start.

Cases: null and empty texts, and texts of white space, have fingerprint zero and link like any
other. A null doc_id keeps its row and never names a component; a component of null ids only has
a null id. Repeated doc_ids keep all their rows. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.llm._common import materialize
from ownerloom.llm.components import connected_components

BITS = 64
DISTANCE = 2
#: Bits in a segment of the first grid.
SEGMENT = 4
#: A cell of the first grid with more fingerprints goes on to the finest grid.
CELL = 24
SEED = 42
WORDS = 3


def fingerprint(text: bytes, shingle_words: int = WORDS) -> int:
    """SimHash of a text's lower-cased UTF-8 over its word shingles: XXH64, seed 42, repeats included."""
    import xxhash

    words = text.lower().split()  # for bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle_words + 1].tolist()
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)), "<u8", len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; one pass over the texts in place."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) if t else 0 for t in map(pa.BinaryScalar.as_py, batch.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def grid_cells(fps: DataFrame, segment: int) -> DataFrame:
    """fp -> (cell, fp): the cell of the segment bit counts and those one step away, as a hash of the vector.

    A hash may join two cells in one, which gives a pair more to verify but loses none.
    """
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
    n = BITS // segment
    weights = np.random.default_rng(20240229).integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1)

    def enter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(column), 20_000):
                fp = column[at : at + 20_000]
                bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts = bits.reshape(len(fp), n, segment).sum(axis=2, dtype=np.uint64)
                own = (counts * weights).sum(axis=1, dtype=np.uint64)  # sums wrap: a linear hash of the vector
                up = np.where(counts < segment, own[:, None] + weights, own[:, None])
                down = np.where(counts > 0, own[:, None] - weights, own[:, None])
                cells = np.concatenate((own[:, None], up, down), axis=1)
                # A step out of range is no cell; own stands there, once.
                keep = np.concatenate((np.ones((len(fp), 1), bool), counts < segment, counts > 0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cells[keep].view("<i8")), pa.array(np.broadcast_to(fp[:, None], cells.shape)[keep])], schema=schema)

    return fps.select("fp").mapInArrow(enter, "cell long, fp long")


def links(distinct: DataFrame, segment: int = SEGMENT, cell_limit: int = CELL) -> DataFrame:
    """Distinct fingerprints (fp) -> pairs (a, b) that keep every component of links at DISTANCE or fewer bits."""
    cells = grid_cells(distinct, segment)
    sizes = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "simhash-cells")
    small = cells.join(sizes.where(F.col("n") <= cell_limit).select("cell"), "cell", "left_semi")
    pairs = (
        small.groupBy("cell")
        .agg(F.sort_array(F.collect_set("fp")).alias("fps"))  # at most cell_limit long
        .select(F.explode(F.expr("flatten(transform(fps, (x, i) -> transform(filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= 2), y -> struct(x AS a, y AS b))))")).alias("p"))
        .select("p.a", "p.b")
    )
    crowded = cells.join(sizes.where(F.col("n") > cell_limit).select("cell"), "cell", "left_semi").select("fp").distinct()
    fine = materialize(grid_cells(crowded, 1), "simhash-fine")
    hubs = fine.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("cell", "a")
    # Two cells of the finest grid may share a hash; the distance is checked to be safe.
    stars = fine.join(hubs, "cell").where("fp <> a AND bit_count(fp ^ a) <= 2").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable) and
    component (its smallest fingerprint)."""
    return grouped(materialize(fingerprints(docs), "simhash-prints"))


def grouped(prints: DataFrame) -> DataFrame:
    """near_duplicates() of fingerprints() that are already a table."""
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    groups = connected_components(links(first))
    named = first.join(groups, first["fp"] == groups["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(least, "component").select("fp", "component_id", "component")
    return prints.join(by_print, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")


def keep_one(docs: DataFrame, groups: DataFrame | None = None, prints: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (then the smallest fingerprint).

    Other groups than those of fingerprints come as a table (doc_id, fp, component), with the function
    that gives the fp of texts.

    Rows that go are found by their ids and leave by an anti join, so texts are shuffled only where
    those ids are too many to broadcast. Ids that several rows share are settled on their own, by
    fingerprint. A component of null ids only keeps one row as well.
    """
    if groups is None:
        groups = materialize(grouped(materialize(fingerprints(docs), "simhash-prints")).select("doc_id", "fp", "component"), "simhash-groups")
    stay = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp")).alias("s")).select("s.doc_id", "s.fp")
    stay = materialize(stay, "simhash-stay")
    shared = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("shared_id"))
    shared = materialize(shared, "simhash-shared")
    gone = groups.select(F.col("doc_id").alias("gone_id")).distinct()
    gone = gone.join(stay, gone["gone_id"].eqNullSafe(stay["doc_id"]), "left_anti")
    gone = materialize(gone.unionByName(shared.select(F.col("shared_id").alias("gone_id"))).distinct(), "simhash-gone")
    id_of = F.col("doc_id").cast("long")
    out = docs.join(gone, id_of.eqNullSafe(F.col("gone_id")), "left_anti")
    if shared.isEmpty():
        return out
    again = docs.join(shared, id_of.eqNullSafe(F.col("shared_id")), "left_semi").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    again = again.withColumn("fp", F.arrow_udf(prints, "long")("text") if prints else F.arrow_udf(_prints, "long")(F.encode("text", "utf-8")))
    again = again.join(stay.withColumnsRenamed({"doc_id": "stay_id", "fp": "stay_fp"}), F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("fp") == F.col("stay_fp")), "left_semi")
    return out.unionByName(again.groupBy("doc_id", "fp").agg(F.first("row").alias("row")).select("row.*"))


def _prints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) if t else 0 for t in texts.to_pylist()], "<u8").view("<i8"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document, whole texts."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
