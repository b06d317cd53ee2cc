"""Benchmark passages in documents, within an edit budget.

An item is normalized (lower case, runs of other than letters and digits become one space) and gets
a budget of edits in proportion to its length. It is cut into budget + 1 pieces: a passage within
the budget must hold one of them unchanged. All pieces are looked for at once (Aho-Corasick), and
where one stands, the stretch of text that the item would cover there is verified by Myers'
bit-parallel edit distance, the item free to begin and end anywhere in that stretch.

The benchmark goes to the workers in blocks of at most BLOCK_CHARS characters, one pass over the
documents for each block, so what a worker holds does not grow with the benchmark. Documents are
never shuffled.

Cases: null and empty texts match nothing; neither do null items and items
without a letter or digit. An item too short for any edit must stand unchanged, by default between word bounds
(in scripts without spaces, anywhere); its budget alone decides that. Repeated items report each of their ids. Null and repeated doc_ids
keep their rows. Texts of any length are searched whole. An empty table gives no rows. Other columns
are not read by contaminated() and stay as they are in remove_contaminated().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.llm._common import fresh, materialize

#: Edits allowed for each 100 characters of an item.
EDITS_PER_100 = 5
#: Normalized characters of benchmark text in one pass.
BLOCK_CHARS = 4_000_000
_GAPS = re.compile(r"[\W_]+")
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Chinese characters: words are not parted by spaces.
_UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normalize(text: str) -> str:
    return _GAPS.sub(" ", text.lower()).strip()


def budget(n_chars: int, edits_per_100: int = EDITS_PER_100) -> int:
    return n_chars * edits_per_100 // 100


def whole_words(text: str, begin: int, end: int) -> bool:
    """Both ends of text[begin:end] are word bounds."""
    return all(at in (0, len(text)) or " " in text[at - 1 : at + 1] or _UNSPACED.search(text[at - 1 : at + 1]) for at in (begin, end))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly equal length that make up the item, with their places."""
    n = edits + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, edits: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of pattern anywhere in text, the first of equals; None above edits."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, None
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | vn
        d0 = (((eq & vp) + vp) ^ vp) | x
        hp = vn | (full & ~(d0 | vp))
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score <= edits and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Finds a block's items in texts; built once a task from the block."""

    def __init__(self, items: list[tuple[int, str]], edits_per_100: int, exact_words: bool = True):
        import ahocorasick

        self.exact_words = exact_words
        self.items = [(item_id, text, budget(len(text), edits_per_100)) for item_id, text in items]
        self.search = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, edits) in enumerate(self.items):
            for at, piece in pieces(text, edits):
                found.setdefault(piece, []).append((k, at))
        for piece, where in found.items():
            self.search.add_word(piece, (len(piece), where))
        self.search.make_automaton()
        self.known: dict[tuple[int, str], tuple[int, int] | None] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, end, length of the normalized text) for each item that stands in the text, its best match."""
        text = normalize(text)
        best: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for end, (length, where) in self.search.iter(text):
            for k, at in where:
                _, item, edits = self.items[k]
                begin = end + 1 - length - at
                if k in best and best[k][0] == 0:
                    continue
                if not edits:
                    if not self.exact_words or whole_words(text, begin, end + 1):
                        best[k] = (0, end + 1)
                    continue
                lo, hi = max(0, begin - edits), min(len(text), begin + len(item) + edits)
                spans = tried.setdefault(k, [])
                if any(a <= lo and hi <= b for a, b in spans[-4:]):
                    continue
                spans.append((lo, hi))
                if text[max(0, begin) : max(0, begin) + len(item)] == item:
                    best[k] = (0, max(0, begin) + len(item))
                    continue
                if hi - lo < len(item) - edits:
                    continue
                stretch = text[lo:hi]
                if (k, stretch) not in self.known:
                    if len(self.known) > 20_000:
                        self.known.clear()
                    self.known[k, stretch] = myers(item, stretch, edits)
                match = self.known[k, stretch]
                if match and (k not in best or match[0] < best[k][0]):
                    best[k] = (match[0], lo + match[1])
        return [(k, d, end, len(text)) for k, (d, end) in sorted(best.items())]


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Normalized items (item_id, text) in blocks of bounded size; only one block is on the driver at a time."""
    block: list[tuple[int, str]] = []
    chars = 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    for item_id, text in rows.toLocalIterator():
        text = normalize(text)
        if not text:
            continue
        block.append((item_id, text))
        chars += len(text)
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, edits_per_100: int = EDITS_PER_100, block_chars: int = BLOCK_CHARS, exact_words: bool = True) -> DataFrame:
    """doc_id, item_id, distance, end (of the match in the normalized text): one row for each document
    and item that stands in it within the item's budget. exact_words: items without a budget must stand as whole words."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("match_end", pa.int64())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ddl = "doc_id long, item_id long, distance long, match_end long"
    out = None
    for block in benchmark_blocks(benchmark, block_chars):
        told = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterable[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(told.value, edits_per_100, exact_words)
                hits = []
                for doc_id, text in zip(batch.column(0).to_pylist(), map(pa.StringScalar.as_py, batch.column(1)), strict=True):
                    if text:
                        hits += [(doc_id, matcher.items[k][0], d, end) for k, d, end, _ in matcher.find(text)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits, strict=True)], schema=schema)

        found = rows.mapInArrow(search, ddl)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], ddl) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, edits_per_100: int = EDITS_PER_100) -> DataFrame:
    """docs without those that hold a benchmark item; rows with a null doc_id are judged by their text alone."""
    key, gone = fresh(docs, "row_key"), "gone_key"
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")))
    bad = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, edits_per_100).select(F.col("doc_id").alias(gone)).distinct()
    bad = materialize(bad, "leaks")  # its size is known before the join is planned
    return keyed.join(bad, keyed[key] == bad[gone], "left_anti").drop(key)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document against the whole benchmark."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
