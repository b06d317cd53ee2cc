"""Quality rules as a bitmask ledger, in built-in functions only.

Every rule is evaluated once. The ledger holds, for each document, what was measured and a bit for
each rule that it fails. A policy is a version of which rules reject; policies are applied, and rules
ablated, on the bits alone, without reading a text again.

Repeated windows are found inside a row: the words' hashes are combined to hashes of 2, 4 and 8
words, sorted with their places, and the places of equal neighbours cover the repeated words. So a
document is never spread over rows, and nothing is shuffled. (Windows are compared by 64-bit hash.)

Cases: a null text is an empty one: no words, all measures 0, base_failed. Texts of any length are
measured whole. Null and repeated doc_ids keep their rows. An empty table gives no rows; ablations
of it are one row a rule with zero counts. Columns that docs has beside doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = "[\\x20\\x09-\\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")

#: Rules in the order of their bits; a rule is true where the document fails. The order is fixed: new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", f"n_words < {MIN_WORDS}"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("dup_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("shouting", "2 * n_bangs > n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeats"]

#: Versioned policies: the bits that reject.
POLICIES: dict[int, int] = {1: BASE, 2: BASE | BIT["symbols"] | BIT["shouting"], 3: (1 << len(RULES)) - 1}
CURRENT = 3


def _without(text: Column, signs: str) -> Column:
    """text less some ASCII signs, by plain byte search."""
    for sign in signs:
        text = F.replace(text, F.lit(sign))
    return text


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of the whole text."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(_without(F.col("text"), "!"))).cast("long").alias("n_bangs"),
        F.when(F.size("words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("h1"),
    )
    # Hashes of 2, 4 and 8 words; the array ends where a window would pass the last word.
    for n, (of, to) in enumerate((("h1", "h2"), ("h2", "h4"), ("h4", "h8"))):
        step = 1 << n
        rows = rows.withColumn(to, F.expr(f"zip_with(slice({of}, 1, size({of}) - {step}), slice({of}, {step + 1}, size({of}) - {step}), (x, y) -> xxhash64(x, y))")).drop(of)
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    rows = rows.withColumn("by_hash", F.when(repeats, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h8")
    # Neighbours in that order with one hash: both their places stand in a repeated window.
    equal = "zip_with(slice(by_hash, 1, size(by_hash) - 1), slice(by_hash, 2, size(by_hash) - 1), (x, y) -> if(x.h = y.h, array(x.i, y.i), array()))"
    rows = rows.withColumn("places", F.when(F.col("by_hash").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.expr(equal)))))).drop("by_hash")
    # Each place covers the words up to the next place, eight at most; the last covers eight.
    gaps = f"aggregate(zip_with(slice(places, 1, size(places) - 1), slice(places, 2, size(places) - 1), (x, y) -> least(y - x, {WINDOW})), {WINDOW}L, (s, g) -> s + g)"
    return rows.withColumn("n_repeat_words", F.when(F.col("places").isNotNull(), F.expr(gaps)).otherwise(F.lit(0)).cast("long")).select("doc_id", *MEASURES)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measures and failures: bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failures", bits)


def verdicts(book: DataFrame, policy: int = CURRENT) -> DataFrame:
    """book with kept under a policy version."""
    return book.withColumn("kept", F.col("failures").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablations(book: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (kept without it), and that fail all of the policy's rules.

    One pass with partial sums of bits; the texts are not read again.
    """
    mask = POLICIES[policy]
    names = [n for n, _ in RULES if BIT[n] & mask]
    bits = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    sums = book.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))  # a row for each pattern of bits
    tests = [(n, BIT[n]) for n in names]
    totals = sums.agg(
        *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(b).cast("long")) != 0, F.col("n"))), F.lit(0)).alias(f"fail_{n}") for n, b in tests],
        *[F.coalesce(F.sum(F.when(F.col("bits") == b, F.col("n"))), F.lit(0)).alias(f"alone_{n}") for n, b in tests],
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.when(F.col("bits") == 0, F.col("n"))), F.lit(0)).alias("kept"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"fail_{n}").alias("failed"), F.col(f"alone_{n}").alias("failed_alone"), (F.col("kept") + F.col(f"alone_{n}")).alias("kept_without")) for n in names])
    return totals.select(F.explode(rows).alias("r"), "documents", "kept").select("r.*", "documents", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the ledger of every document under the current policy."""
    book = verdicts(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    failed = F.col("failures").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failures")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), p AS (
  SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8
), h AS (
  SELECT k, i, array_to_string(words[i:i + 7], ' ') AS win FROM p
), r AS (
  SELECT k, i FROM h QUALIFY count(*) OVER (PARTITION BY k, win) > 1
), c AS (
  SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM r) GROUP BY k
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
  FROM w LEFT JOIN c USING (k)
), f AS (
  SELECT *, (n_words < 20)::INT AS b0, (100 * n_repeat_words > 30 * n_words)::INT AS b1, (10 * n_symbols > 3 * n_words)::INT AS b2,
    (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::INT AS b3, (word_chars < 2 * n_words)::INT AS b4, (word_chars > 20 * n_words)::INT AS b5, (2 * n_bangs > n_words)::INT AS b6
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  b0 + b1 > 0 AS base_failed, b0 + b1 + b2 + b3 + b4 + b5 + b6 = 0 AS kept,
  CAST(b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 AS BIGINT) AS failures
FROM f
"""
