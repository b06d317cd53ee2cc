"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of a text, by built-in functions.
2. A small forest is grown on labelled rows; each path from a root to a node is a conjunctive rule.
3. A logistic regression with a lasso penalty weighs the rules; most weights become zero.
4. The rules that are left are compiled to one column expression, so scoring is a plain projection
   over the texts: no shuffle, no Python.

Labels are learned from rows whose held_out() is false, about TRAIN_ROWS of them (a bound of the
fit, chosen by a hash of the id). Labels, lang, source and doc_id are not inputs of a score. The same
rows give the same model, however they are partitioned and in whatever order they come.

Cases: a null text is an empty one and is scored like any other. With labels of one kind only every
score is their mean (0 or 1); without labels it is 0.5. Null labels are not learned from. Null and
repeated doc_ids keep their rows; a text of any length is measured whole. An empty table gives no rows. scored()
keeps other columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.llm._common import fresh, held_out, materialize, unit_hash

TRAIN_ROWS = 20_000
TREES = 12
DEPTH = 3
PENALTY = 0.002
SEED = 17
#: Partitions of the training rows; the forest samples each with a seed of its own.
FIT_PARTITIONS = 6
#: Decimals of a rule's weight: sums of doubles differ in their last digits with the order of tasks.
WEIGHT_DECIMALS = 6

STATISTICS = ("log_words", "mean_word", "distinct_share", "symbol_rate", "bang_rate", "bar_rate", "upper_share", "digit_share", "dup_line_share", "line_rate", "comma_rate", "stop_rate")


def _count(text: Column, signs: str) -> Column:
    """How often ASCII signs stand in a text."""
    rest = text
    for sign in signs:
        rest = F.replace(rest, F.lit(sign))
    return F.length(text) - F.length(rest)


def statistics(docs: DataFrame, text_column: str = "text", name: str = "stats") -> DataFrame:
    """docs with a struct column of STATISTICS under a name that docs must not have."""
    text, words, lines = (fresh(docs, x) for x in ("q_text", "q_words", "q_lines"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    rows = rows.withColumn(words, F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    rows = rows.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0))
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    upper = F.length(text) - F.length(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    values = {
        "log_words": F.log1p(F.size(words).cast("double")),
        "mean_word": F.length(F.array_join(words, "")) / n,
        "distinct_share": F.size(F.array_distinct(words)) / n,
        "symbol_rate": _count(F.col(text), "#*$%&<>") / n,
        "bang_rate": _count(F.col(text), "!") / n,
        "bar_rate": _count(F.col(text), "|") / n,
        "upper_share": upper / chars,
        "digit_share": _count(F.col(text), "0123456789") / chars,
        "dup_line_share": (F.size(lines) - F.size(F.array_distinct(lines))) / n_lines,
        "line_rate": F.size(lines) / n,
        "comma_rate": _count(F.col(text), ",") / n,
        "stop_rate": _count(F.col(text), ".") / n,
    }
    return rows.withColumn(name, F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])).drop(text, words, lines)


@dataclass
class RuleModel:
    """Rules are conjunctions of (statistic, is_below, threshold); a score is logistic in their weighted sum."""

    intercept: float = 0.0
    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]] = field(default_factory=list)
    constant: float | None = None

    def column(self, stats: str = "stats") -> Column:
        """The score as one expression over the struct column stats."""
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            total = total + F.when(condition_column(conditions, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition_column(conditions: tuple[tuple[str, bool, float], ...], stats: str = "stats") -> Column:
    out = F.lit(True)
    for name, below, threshold in conditions:
        value = F.col(f"{stats}.{name}")
        out = out & ((value <= threshold) if below else (value > threshold))
    return out


def tree_paths(trees: list, names: tuple[str, ...]) -> list[tuple[tuple[str, bool, float], ...]]:
    """All paths from the root to an inner node's child, each once, simplest first."""
    found: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found[tuple(sorted(path))] = None
        if node.getClass().getSimpleName() == "InternalNode":
            name, threshold = names[node.split().featureIndex()], node.split().threshold()
            walk(node.leftChild(), (*path, (name, True, threshold)))
            walk(node.rightChild(), (*path, (name, False, threshold)))

    for tree in trees:
        walk(tree._call_java("rootNode"), ())
    return sorted(found, key=lambda p: (len(p), p))


def in_fixed_order(labelled: DataFrame) -> DataFrame:
    """The rows dealt to partitions and sorted by their values alone. Equal rows are counted before they are
    shuffled and dealt by their copy number, so that many copies do not meet in one task."""
    counted = labelled.groupBy("label", "stats").agg(F.count("*").cast("int").alias("copies"))
    rows = counted.select("label", "stats", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return rows.repartition(FIT_PARTITIONS, "label", "stats", "copy").sortWithinPartitions("label", "stats").drop("copy")


def fit_rules(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """labelled: stats (struct of STATISTICS) and label (0.0 or 1.0), of bounded size."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return RuleModel(constant=next(iter(counts), 0.5))
    labelled = in_fixed_order(labelled)
    flat = labelled.select("label", *[F.col(f"stats.{k}").alias(k) for k in STATISTICS])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(flat)
    # Both kinds weigh alike, so that rules for the rarer kind are grown as well. Weights in 1/1024 have exact sums.
    total = sum(counts.values())
    weights = {kind: round(1024 * total / (2 * n)) / 1024 for kind, n in counts.items()}
    weight = F.when(F.col("label") == 1, F.lit(weights[1.0])).otherwise(F.lit(weights[0.0]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=SEED, weightCol="weight", featureSubsetStrategy="onethird").fit(vectors.withColumn("weight", weight))
    rules = tree_paths(forest.trees, STATISTICS)
    if not rules:
        return RuleModel(constant=counts[1.0] / total)
    marks = labelled.select("label", F.array(*[condition_column(r).cast("double") for r in rules]).alias("marks"))
    from pyspark.ml.functions import array_to_vector

    marks = marks.select("label", array_to_vector("marks").alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(marks)
    weights = [round(w, WEIGHT_DECIMALS) for w in lasso.coefficients.toArray().tolist()]
    return RuleModel(intercept=round(float(lasso.intercept), WEIGHT_DECIMALS), rules=[(r, w) for r, w in zip(rules, weights, strict=True) if w])


def training_rows(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and label of about bound labelled documents that are not held out.

    A repeated label counts once, so chosen labels are no more than the sample. Documents that repeat
    an id would make the rows more than that: then they are thinned by a hash of id and text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(target).cast("double").alias("label"))
    known = known.where(F.col("label_id").isNotNull() & F.col("label").isin(0.0, 1.0) & ~held_out("label_id")).distinct()
    n = known.count()
    chosen = known if n <= bound else known.where(unit_hash("label_id", seed=2) < bound / n)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The sample bounds what is broadcast.
    joined = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"]).select("doc_id", "text", "label")
    repeated = joined.count()
    if repeated > 2 * bound:
        joined = joined.where(unit_hash("doc_id", "text", seed=3) < bound / repeated)
    joined = joined.select("text", "label")
    # Joined and measured in as many tasks as the texts have; the bounded rows that are left go to few files.
    return materialize(statistics(joined).select("stats", "label").repartition(FIT_PARTITIONS), "quality-train")


def fit_quality(docs: DataFrame, labels: DataFrame) -> RuleModel:
    return fit_rules(training_rows(docs, labels))


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    stats = fresh(docs, "stats")
    out = statistics(docs.select(*kept), name=stats).withColumn("score", model.column(stats))
    return out.select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel) -> DataFrame:
    """Rows of docs whose score is 0.5 or more, with the columns of docs.

    The optimizer would push the condition below the statistics and so count them anew for every rule;
    a column that is not deterministic, and that the condition names, keeps it above them.
    """
    guard = fresh(docs, "row_guard")
    rows = statistics(docs.select(F.struct("*").alias("row"), F.col("text"))).withColumn(guard, F.monotonically_increasing_id())
    return rows.where((model.column() >= 0.5) & (F.col(guard) >= 0)).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document, whole texts."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs.select("doc_id", "text"), fit_quality(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
