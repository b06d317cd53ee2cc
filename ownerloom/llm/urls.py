"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is built-in functions and Spark's own boosted trees; the fitted trees are compiled to one
column expression.

Rules have a host and a path. A rule fits its host and all subdomains if the url's path starts with
the rule's; of several the longest wins (by the characters of host and path together, then the
longer host, then the rule's text). Up to COMPILED rules become one expression. More are joined: a
url's host suffixes and path prefixes (only of lengths that rules have) are its keys, and each key
meets at most one rule.

The trees learn from urls with a label (allow or block), about TRAIN_ROWS distinct ones, chosen by a hash of
the url. The registered query takes the urls on which a rule speaks as labelled. A feature is the share of
allowed urls among the training urls with the same last part of the host, smoothed; a training url takes the share
that the other FOLDS - 1 folds of urls have, so that its own label has no part in it (leaving out its label alone would
tell it: the share is then lower for an allowed url). That table is as small as the training rows.

Cases: null urls and urls without `://` have an empty host and path and no rule; the trees still judge
them. With labels of one kind only that kind is the verdict, without labels it is allow. A url with both labels
is learned once with each. Null and repeated page_ids keep their rows. Urls of any length are judged whole. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.llm._common import materialize, unit_hash

#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
COMPILED = 256
TRAIN_ROWS = 20_000
#: Files of the bounded training table.
TRAIN_FILES = 4
#: Folds of training urls, by a hash of the url, for their suffixes' shares.
FOLDS = 5
#: Weight of the prior in a suffix's share, in urls.
PRIOR_URLS = 20
#: Parts over which urls without a host are dealt where rules are joined.
SALTS = 64
TREES = 12
DEPTH = 4
SEED = 11
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_parts", "digit_share", "host_digit_share", "entropy", "n_params", "query_length", "has_fragment", "n_hyphens", "n_encoded", "is_https", "longest_part", "suffix_share")


def host_and_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host (A-Z lower-cased) and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.regexp_extract(text, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    return urls.withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)


def _rule_rows(rules) -> list[tuple[str, str, str, str]]:
    """(verdict, host, path, text), the winning one first."""
    rows = [(v, h.translate(str.maketrans(UPPER, LOWER)), p, f"{h}{p}") for v, h, p in rules]
    return sorted(rows, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[3]))


def with_rules(rows: DataFrame, rules=RULES, compiled: int = COMPILED) -> DataFrame:
    """rows (host, path) with rule and rule_verdict, null where no rule fits."""
    listed = _rule_rows(rules)
    if not listed:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(listed) <= compiled:
        told = None
        for verdict, host, path, text in listed:
            fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
            answer = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("rule_verdict"))
            told = F.when(fits, answer) if told is None else told.when(fits, answer)
        return rows.withColumn("told", told).select(*rows.columns, "told.rule", "told.rule_verdict")
    table = rows.sparkSession.createDataFrame([(h, p, v, t, len(h) + len(p), len(h)) for v, h, p, t in dict(((r[1], r[2]), r) for r in reversed(listed)).values()], "rule_host string, rule_path string, rule_verdict string, rule string, size int, host_size int")
    lengths = F.array(*[F.lit(n) for n in sorted({len(r[2]) for r in listed})])
    parts = F.split("host", "\\.")
    suffixes = F.expr("transform(sequence(1, size(parts)), k -> array_join(slice(parts, k, size(parts)), '.'))")
    keyed = rows.select("host", "path").distinct().withColumn("parts", parts).withColumn("rule_host", F.explode(suffixes))
    keyed = keyed.withColumn("n", F.explode(F.filter(lengths, lambda n: n <= F.length("path")))).withColumn("rule_path", F.expr("substring(path, 1, n)"))
    best = keyed.join(table, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct("size", "host_size", F.lit(0))).alias("told"))
    # All urls without a host share one key; they are dealt over several, of which the rules have the first.
    salt = F.when(F.col("host") == "", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    every = F.expr(f"explode(if(host = '', sequence(0L, {SALTS - 1}L), array(0L)))")
    salted, best = rows.withColumn("salt", salt), best.withColumn("salt", every)
    return salted.join(best, ["host", "path", "salt"], "left").select(*rows.columns, "told.rule", "told.rule_verdict")


def _share(part: Column, of: Column) -> Column:
    return part / F.greatest(of, F.lit(1))


def _digits(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "0123456789", ""))


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """rows (host, path) with the lexical features and `suffix`, the host's last part."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.length(F.replace(text, c)))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))
    parts = F.split("path", "/")
    values = {
        "url_length": n,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "depth": F.size(F.array_remove(parts, "")),
        "host_parts": F.size(F.array_remove(F.split("host", "\\."), "")),
        "digit_share": _share(_digits(text), n),
        "host_digit_share": _share(_digits(F.col("host")), F.length("host")),
        "entropy": entropy,
        "n_params": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0),
        "query_length": F.length(query),
        "has_fragment": F.contains(text, F.lit("#")).cast("int"),
        "n_hyphens": n - F.length(F.replace(text, F.lit("-"))),
        "n_encoded": n - F.length(F.replace(text, F.lit("%"))),
        "is_https": F.startswith(text, F.lit("https://")).cast("int"),
        "longest_part": F.array_max(F.transform(parts, lambda p: F.length(p))),
    }
    return rows.withColumns({k: v.cast("double") for k, v in values.items()} | {"suffix": F.element_at(F.split("host", "\\."), -1)})


@dataclass
class UrlModel:
    """Boosted trees as nested expressions; constant where the labels were of one kind."""

    trees: list
    suffixes: DataFrame | None = None
    prior: float = 0.5
    constant: str | None = None
    #: Spark's own model, of which trees is the compiled form.
    fitted: object | None = None

    def with_shares(self, rows: DataFrame) -> DataFrame:
        """rows (suffix) with suffix_share; hosts of an unknown suffix have the prior."""
        joined = rows.join(F.broadcast(self.suffixes), "suffix", "left")
        return joined.withColumn("suffix_share", F.coalesce("suffix_share", F.lit(self.prior)))

    def margin(self) -> Column:
        def node(n) -> Column:
            if n[0] == "leaf":
                return F.lit(n[1])
            _, name, threshold, left, right = n
            return F.when(F.col(name) <= threshold, node(left)).otherwise(node(right))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * node(root)
        return total

    def verdict(self, rows: DataFrame) -> DataFrame:
        """rows (lexical features) with model_score (0..1, higher: allow) and model_verdict."""
        if self.constant is not None:
            return rows.withColumns({"model_score": F.lit(1.0 if self.constant == "allow" else 0.0), "model_verdict": F.lit(self.constant)})
        scored = self.with_shares(rows).withColumn("model_score", 1 / (1 + F.exp(-2 * self.margin())))
        return scored.withColumn("model_verdict", F.when(F.col("model_score") >= 0.5, "allow").otherwise("block"))


def _tree(node, names) -> tuple:
    if node.getClass().getSimpleName() != "InternalNode":
        return ("leaf", node.prediction())
    split = node.split()
    return ("split", names[split.featureIndex()], split.threshold(), _tree(node.leftChild(), names), _tree(node.rightChild(), names))


def training_urls(labelled: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """Lexical features, suffix and label of about bound distinct labelled urls, as a small table."""
    n = labelled.count()
    chosen = labelled if n <= bound else labelled.where(unit_hash("url", seed=1) < bound / n)
    rows = lexical(host_and_path(chosen.select("url", "label").distinct())).drop("host", "path")
    return materialize(rows.repartition(TRAIN_FILES), "url-train")


def fit_urls(labelled: DataFrame, bound: int = TRAIN_ROWS) -> UrlModel:
    """labelled: url and label (1.0 allow, 0.0 block)."""
    from pyspark.ml.classification import GBTClassifier

    rows = training_urls(labelled, bound)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if len(counts) < 2:
        return UrlModel([], constant="allow" if next(iter(counts), 1.0) else "block")
    prior = counts[1.0] / sum(counts.values())
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    sums = materialize(rows.groupBy("suffix").agg(F.sum("label").alias("allowed"), F.count("*").alias("urls")), "url-suffixes")
    folds = rows.groupBy("suffix", "fold").agg(F.sum("label").alias("fold_allowed"), F.count("*").alias("fold_urls"))
    share = lambda allowed, urls: (allowed + PRIOR_URLS * prior) / (urls + PRIOR_URLS)
    others = share(F.col("allowed") - F.col("fold_allowed"), F.col("urls") - F.col("fold_urls"))
    # Both kinds weigh alike, so that the rarer one is told as well.
    weight = F.when(F.col("label") == 1, 1 / (2 * prior)).otherwise(1 / (2 * (1 - prior)))
    train = rows.join(F.broadcast(sums), "suffix").join(F.broadcast(folds), ["suffix", "fold"]).withColumns({"suffix_share": others, "weight": weight}).select("label", "weight", *FEATURES)
    model = GBTClassifier(weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=32, checkpointInterval=-1).fit(feature_vectors(train))
    suffixes = sums.select("suffix", share(F.col("allowed"), F.col("urls")).alias("suffix_share"))
    return UrlModel([(float(w), _tree(t._call_java("rootNode"), FEATURES)) for t, w in zip(model.trees, model.treeWeights, strict=True)], suffixes, prior, fitted=model)


def feature_vectors(rows: DataFrame) -> DataFrame:
    """rows with FEATURES as one vector column, as the trees take them."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def judged(pages: DataFrame, rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, model_score; without a model one is fitted on the urls on which a rule speaks."""
    rows = with_rules(host_and_path(pages.select("page_id", "url")), rules)
    if model is None:
        told = rows.where("rule IS NOT NULL").select("url", (F.col("rule_verdict") == "allow").cast("double").alias("label"))
        model = fit_urls(told)
    out = model.verdict(lexical(rows))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "model_verdict").alias("verdict"), "model_score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every page's url."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
