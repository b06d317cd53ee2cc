"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, derived from its code point. A trigram's vector binds
its letters' vectors, each permuted by its place (rolled by 2, 1 and 0) and multiplied. A text's
vector bundles (adds) its trigrams' vectors; a language's prototype bundles those of its training
texts. A text goes to the prototype with the largest cosine. Words are lower-cased runs of letters
with a space on either side; other characters part words.

Training texts: rows with a language whose held_out() is false, about TRAIN_PER_LANGUAGE of each
language (chosen by a hash of id and text, equal texts once; a bound of the fit, not of the prediction). Bundles are summed
in Spark, and the driver gets one vector a language.

Cases: null texts and texts without a letter are `und` with score 0; without any training row all
are. Ties go to the first language by name. Null and repeated doc_ids keep their rows. An empty
table gives no rows. Of other columns only lang is read, and only to train.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.llm._common import fresh, give_back, held_out, unit_hash, worker_keeps

DIMENSIONS = 1024
TRAIN_PER_LANGUAGE = 4_000
#: A worker keeps the vectors of at most so many trigrams and starts anew beyond that.
TRIGRAMS_KEPT = 32_000
#: Trigrams' vectors are added up so many at a time, and room is made for so many at a time (memory, not results).
TRIGRAMS_AT_ONCE = 1024
UNKNOWN = "und"
#: The share of training texts of a size that may lie below the floor, and how many texts a floor needs.
FLOOR_QUANTILE = 0.001
FLOOR_ROWS = 50

_letters: dict[int, np.ndarray] = {}
_table: list = []


def letter_vector(code: int) -> np.ndarray:
    """The random +1/-1 vector of a code point (0: the space), the same on every machine."""
    if code not in _letters:
        bits = np.random.default_rng([20240613, code]).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _letters[code] = 2 * bits - 1
    return _letters[code]


def _letter_table() -> np.ndarray:
    """Code point -> itself where it is a letter, else 0."""
    if not _table:
        _table.append(np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000))
    return _table[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram keys of a text and their counts; none if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    kept = np.concatenate(([0], _letter_table()[codes], [0])).astype(np.uint64)
    kept = kept[np.concatenate(([True], (kept[1:] != 0) | (kept[:-1] != 0)))]  # one space between words
    if len(kept) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = (kept[:-2] << np.uint64(42)) | (kept[1:-1] << np.uint64(21)) | kept[2:]
    return np.unique(keys, return_counts=True)


class Bundler:
    """Text vectors; keeps a row of the matrix for each trigram seen."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((2 * TRIGRAMS_AT_ONCE, DIMENSIONS), np.int8)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the trigrams' vectors, which are bound here when first seen."""
        listed = keys.tolist()
        for key in [k for k in listed if k not in self.rows]:
            a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
            row = len(self.rows)
            if row == len(self.matrix):
                self.matrix = np.concatenate((self.matrix, np.empty((max(TRIGRAMS_AT_ONCE, row // 4), DIMENSIONS), np.int8)))
            self.matrix[row] = np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
            self.rows[key] = row
        return np.fromiter(map(self.rows.__getitem__, listed), np.int64, len(listed))

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """One vector a text; zero where it has no letter."""
        if len(self.rows) > TRIGRAMS_KEPT:
            self.clear()
        found = [trigrams(t) if t else (np.empty(0, np.uint64), np.empty(0, np.int64)) for t in texts]
        sizes = [len(k) for k, _ in found]
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        weights = np.zeros((len(texts), len(keys)), np.float32)
        weights[np.repeat(np.arange(len(texts)), sizes), place] = np.concatenate([n for _, n in found])
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        rows = self.places(keys)
        for at in range(0, len(keys), TRIGRAMS_AT_ONCE):
            out += weights[:, at : at + TRIGRAMS_AT_ONCE] @ self.matrix[rows[at : at + TRIGRAMS_AT_ONCE]].astype(np.float32)
        return out


def _groups(batches: Iterable[pa.RecordBatch], rows: int = 96) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def training_rows(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame | None:
    """The bounded sample (doc_id, text, lang) that is learned from; None without a labelled row."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = F.lit(1.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    return rows.where(unit_hash("doc_id", "text", seed=8) < share).dropDuplicates(["lang", "text"])


def fit_prototypes(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> dict[str, list[float]]:
    """Language -> prototype, from rows of docs (doc_id, text, lang) that are not held out."""
    chosen = training_rows(docs, per_language)
    if chosen is None:
        return {}
    schema = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("value", pa.float64())])

    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("langid")  # nothing; what packing kept in the worker goes
        sums: dict[str, np.ndarray] = {}
        bundler = Bundler()
        for part in _groups(batches):
            vectors = bundler.bundles(part.column(1).to_pylist())
            # Each text counts alike, however long it is.
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            for lang, vector in zip(part.column(0).to_pylist(), vectors, strict=True):
                if lang in sums:
                    sums[lang] += vector
                else:
                    sums[lang] = vector.astype(np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], schema=schema)

    parts = chosen.select("lang", "text").mapInArrow(bundle, "lang string, place int, value double")
    summed = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    return {r["lang"]: [p["value"] for p in r["v"]] for r in summed.collect() if any(p["value"] for p in r["v"])}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text_column: str = "text") -> DataFrame:
    """docs with lang_pred and score (cosine, cut to 0..1); other columns stay as they are.

    The texts alone go to Python; the rest of a row waits in the JVM.
    """
    langs = sorted(prototypes)
    units = np.array([prototypes[x] for x in langs], np.float32).reshape(len(langs), DIMENSIONS)
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-9)

    def judged(bundler: Bundler, texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for at in range(0, len(texts), 96):
            vectors = bundler.bundles(texts.slice(at, 96).to_pylist())
            norms = np.linalg.norm(vectors, axis=1)
            if not langs:
                norms[:] = 0
                cosines = np.zeros((len(norms), 1), np.float32)
            else:
                cosines = (vectors @ units.T) / np.maximum(norms, 1e-9)[:, None]
            best = cosines.argmax(axis=1)
            names += [langs[k] if n else UNKNOWN for k, n in zip(best, norms, strict=True)]
            scores += np.where(norms > 0, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker_keeps("langid")
        bundler = Bundler()  # one a task: its vectors do not stay in the worker for later stages
        for texts in batches:
            yield judged(bundler, texts)
        bundler.clear()
        give_back()

    each.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    judge = F.arrow_udf(each, "struct<lang_pred:string,score:double>")
    told = fresh(docs, "judged")
    out = docs.withColumn(told, judge(F.col(text_column).cast("string")))
    return out.select(*[c for c in docs.columns if c.lower() not in ("lang_pred", "score")], f"{told}.lang_pred", f"{told}.score")


def _size_class(text: Column) -> Column:
    """The binary logarithm of a text's length, in whole numbers."""
    return F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))).cast("int")


def fit_floors(docs: DataFrame, prototypes: dict[str, list[float]]) -> dict[int, float]:
    """Size class -> the FLOOR_QUANTILE of the cosines that training texts of the class have with their own
    language; classes with fewer than FLOOR_ROWS texts are left out. One row a class comes to the driver."""
    chosen = training_rows(docs)
    if chosen is None:
        return {}
    told = identify(chosen, prototypes).where("lang_pred = lang")
    low = told.groupBy(_size_class(F.col("text")).alias("size")).agg(F.percentile_approx("score", FLOOR_QUANTILE, 100_000).alias("floor"), F.count("*").alias("n"))
    return {r["size"]: r["floor"] for r in low.where(F.col("n") >= FLOOR_ROWS).collect()}


def is_learned(floors: dict[int, float], text_column: str = "text") -> Column:
    """True where score reaches the floor of the text's size class. A class without a floor takes that of the
    next smaller class; texts smaller than all of them cannot be told and pass."""
    size, floor = _size_class(F.col(text_column).cast("string")), F.lit(0.0)
    for k in sorted(floors):
        floor = F.when(size >= k, F.lit(floors[k])).otherwise(floor)
    return F.col("score") >= floor


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document, whole texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), fit_prototypes(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
