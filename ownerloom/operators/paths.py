"""Paths and cases: samples, locations, sizes, file kinds, languages, attributes, template plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ownerloom.functions.scalars import hash_bucket

MAX_FILE_BYTES = 8 * 1024 * 1024
MARKER_SIZE = 7
CASE_FILES = ("Base", "Left", "Right", "Expected")
#: Other files of a case (fixed values).
CASE_NOTES = ("file_name", "final_path", "source_url")

#: What whole paths, base names and suffixes stand for, as file type, family and dialect.
EXACT_PATHS = {".git-hooks/commit-msg": ("ruby", "ruby", "ruby"), ".git-hooks/prepare-commit-msg": ("bash", "bash", "bash")}
BASE_NAMES = {
    "Gemfile": ("gemfile", "ruby", "ruby"),
    "Appraisal.root.gemfile": ("gemfile", "ruby", "ruby"),
    "Appraisals": ("appraisals", "ruby", "ruby"),
    "Rakefile": ("ruby", "ruby", "ruby"),
    ".simplecov": ("ruby", "ruby", "ruby"),
    ".envrc": ("bash", "bash", "bash"),
    ".tool-versions": ("tool_versions", "text", "tool_versions"),
    "CITATION.cff": ("yaml", "yaml", "yaml"),
}
SUFFIXES = (
    (r"\.gemspec$", ("gemspec", "ruby", "ruby")),
    (r"\.gemfile$", ("gemfile", "ruby", "ruby")),
    (r"\.(rb|rake)$", ("ruby", "ruby", "ruby")),
    (r"\.(yml|yaml)$", ("yaml", "yaml", "yaml")),
    (r"\.(md|markdown)$", ("markdown", "markdown", "markdown")),
    (r"\.(sh|bash)$", ("bash", "bash", "bash")),
    (r"(^|/)\.env(\.[^/]*)?$", ("dotenv", "dotenv", "dotenv")),
    (r"\.json5$", ("json", "json", "json5")),
    (r"\.jsonc$", ("json", "json", "jsonc")),
    (r"\.json$", ("json", "json", "json")),
    (r"\.toml$", ("toml", "toml", "toml")),
    (r"\.rbs$", ("rbs", "rbs", "rbs")),
)
#: Names of languages and the extensions that stand for them.
LANGUAGE_NAMES = {"go": "go", "golang": "go", "json": "json", "jsonc": "jsonc", "json with comments": "jsonc", "json5": "json5", "plain": "text", "text": "text", "plaintext": "text", "text/plain": "text"}
LANGUAGE_EXTENSIONS = ("go", "json", "jsonc", "json5")


def sample_hash_bucket(df: DataFrame, id_column: str, modulus: int, bucket: int) -> DataFrame:
    """Rows whose id falls in one bucket of a digest: the same sample on every run."""
    return df.where(hash_bucket(F.col(id_column).cast("string"), modulus) == bucket)


def locate_case(paths: DataFrame, extensions: list[str], path: str = "path") -> DataFrame:
    """paths with case_id, extension and file (Base, Left, Right, Expected or one of CASE_NOTES); rows that are no
    file of a case are dropped.

    A case file is [folders/]ext/owner/repo/commit/hash/<name>, relative and without `..`, where name is
    <Base|Left|Right|Expected>.ext or one of CASE_NOTES; the case id begins at the extension."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: ~x.isin("", "."))
    located = paths.withColumn("parts", parts).where((F.size("parts") >= 6) & ~F.startswith(F.col(path), F.lit("/")) & ~F.array_contains("parts", ".."))
    located = located.withColumn("parts", F.slice("parts", -6, 6)).withColumn("extension", F.get("parts", F.lit(0))).where(F.col("extension").isin(extensions))
    name = F.get("parts", F.lit(5))
    file = F.when(name.isin(*CASE_NOTES), name).when(F.array_contains(F.array(*[F.concat(F.lit(f"{f}."), "extension") for f in CASE_FILES]), name), F.substring_index(name, ".", 1))
    return located.withColumn("file", file).where("file IS NOT NULL").withColumn("case_id", F.array_join(F.slice("parts", 1, 5), "/")).drop("parts")


def flag_oversize(cases: DataFrame, columns: tuple[str, ...] = ("base", "left", "right", "expected"), max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """cases with status: `oversize` where any file is larger than max_bytes, else `pending`."""
    largest = F.greatest(F.lit(0), *[F.coalesce(F.octet_length(c), F.lit(0)) for c in columns])
    return cases.withColumn("status", F.when(largest > max_bytes, "oversize").otherwise("pending"))


def classify_path(path: Column) -> Column:
    """struct(file_type, family, dialect): by whole path, then base name, then suffix, else text."""
    plain = F.regexp_replace(path, r"^(\./)+", "")
    base, lower = F.element_at(F.split(plain, "/"), -1), F.lower(plain)
    kind = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("file_type", "family", "dialect"), v, strict=True)])
    tests = [(plain == k, v) for k, v in EXACT_PATHS.items()] + [(base == k, v) for k, v in BASE_NAMES.items()] + [(lower.rlike(k), v) for k, v in SUFFIXES]
    out = None
    for test, v in tests:
        out = F.when(test, kind(v)) if out is None else out.when(test, kind(v))
    return out.otherwise(kind(("text", "text", "text")))


def detect_language(language: Column, path: Column) -> Column:
    """A known language name (trimmed, any case), else the path's extension, else text."""
    named = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])[F.lower(F.trim(F.coalesce(language, F.lit(""))))]
    base = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(base, r"[^/]\.([^./]+)$", 1)
    return F.coalesce(named, F.when(extension.isin(*LANGUAGE_EXTENSIONS), extension), F.lit("text"))


def resolve_path_attributes(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path with language, profile and marker_size under attribute rules.

    rules: directory (`` for the root), rule_order (within its file), pattern, key, value. A rule counts
    for paths under its directory; a pattern without `/` is matched on the base name; one `*` stands for
    anything; deeper directories and later rules win for each key; marker sizes below 1 are ignored.
    Rules meet paths by directory and so by an equi-join on each ancestor, not by all pairs.
    """
    distinct = paths.select("path").distinct()
    parts = F.split("path", "/")
    depth = F.size(parts) - 1
    ancestors = F.transform(F.sequence(F.lit(0), depth), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    near = distinct.withColumn("directory", F.explode(F.array_distinct(ancestors)))
    value = F.when(F.contains("pattern", F.lit("/")), F.col("path")).otherwise(F.element_at(parts, -1))
    star = F.instr("pattern", "*")
    glob = F.when(F.col("pattern") == "*", F.lit(True)).when(
        star > 0, F.startswith(value, F.substring_index("pattern", "*", 1)) & F.endswith(value, F.expr("substring(pattern, instr(pattern, '*') + 1)"))
    ).otherwise(F.col("pattern") == value)
    fits = near.join(rules, "directory").where((F.col("pattern") == F.col("path")) | glob)
    valid = (F.col("key") != "conflict-marker-size") | F.coalesce(F.expr("try_cast(value AS int)") > 0, F.lit(False))
    order = F.struct(F.length("directory"), "rule_order")
    pick = lambda *keys: F.max_by(F.when(F.col("key").isin(*keys), F.col("value")), F.when(F.col("key").isin(*keys), order))
    found = fits.where(valid).groupBy("path").agg(pick("language", "linguist-language").alias("language"), pick("profile").alias("profile"), pick("conflict-marker-size").cast("int").alias("marker_size"))
    return distinct.join(found, "path", "left").withColumn("marker_size", F.coalesce("marker_size", F.lit(MARKER_SIZE)))


def logical_path(path: Column) -> Column:
    """A template's path without `.no-osc.example` or `.example`."""
    return F.regexp_replace(path, r"(\.no-osc)?\.example$", "")


def plan_template_paths(templates: DataFrame, overrides: DataFrame, default: str = "merge", project: str | None = None, omitted: tuple[str, ...] = ()) -> DataFrame:
    """templates (template_source_path) with logical path, destination (null: omit), kind, strategy and action.

    omitted: logical paths that have no destination, such as a tool's own settings. overrides: path, strategy, override_order; the first that matches wins, else the default.
    """
    rows = templates.withColumn("logical_destination_path", logical_path(F.col("template_source_path")))
    logical = F.col("logical_destination_path")
    gem = F.lit(f"{project.strip()}.gemspec") if project and project.strip() else logical
    destination = F.when(logical.isin(*omitted), F.lit(None)).when(logical == ".env.local", ".env.local.example").when(logical == "gem.gemspec", gem).otherwise(logical)
    rows = rows.withColumns({"destination_path": destination, "kind": classify_path(logical), "key": F.regexp_replace(logical, r"^(\./)+", "")})
    first = Window.partitionBy("key").orderBy("override_order")
    chosen = overrides.select(F.regexp_replace("path", r"^(\./)+", "").alias("key"), "strategy", "override_order").withColumn("n", F.row_number().over(first)).where("n = 1").select("key", "strategy")
    out = rows.join(chosen, "key", "left").withColumn("strategy", F.coalesce("strategy", F.lit(default)))
    return out.withColumn("action", F.when(F.col("destination_path").isNull(), "omit").otherwise(F.col("strategy"))).drop("key")


def plan_template_execution(planned: DataFrame, destinations: DataFrame) -> DataFrame:
    """planned with destination_exists, write_action (omit, keep, update, create), execution_action and ready.

    destinations: destination_path. planned may have blocked (boolean): unresolved tokens.
    """
    there = destinations.select("destination_path").distinct().withColumn("destination_exists", F.lit(True))
    rows = planned.join(there, "destination_path", "left").withColumn("destination_exists", F.coalesce("destination_exists", F.lit(False)))
    if "blocked" not in rows.columns:
        rows = rows.withColumn("blocked", F.lit(False))
    write = F.when(F.col("destination_path").isNull(), "omit").when(F.col("strategy") == "keep_destination", "keep").when(F.col("destination_exists"), "update").otherwise("create")
    rows = rows.withColumn("write_action", write)
    execution = (
        F.when(F.col("blocked"), "blocked").when(F.col("write_action") == "omit", "omit").when(F.col("write_action") == "keep", "keep").when(F.col("strategy") == "raw_copy", "raw_copy")
        .when((F.col("strategy") == "accept_template") | ~F.col("destination_exists"), "write").otherwise("merge")
    )
    return rows.withColumn("execution_action", execution).withColumn("ready", F.col("execution_action").isin("write", "merge", "raw_copy"))
