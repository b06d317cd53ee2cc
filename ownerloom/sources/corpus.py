"""Case corpora, manifests, file trees and result files; resumable runs; plug-in analyzers and handlers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ownerloom.operators.cutting import validate_owners
from ownerloom.operators.paths import CASE_FILES, CASE_NOTES, locate_case

MANIFEST = "case_id string, repository string, extension string, path_name string, estimated_input_bytes long, shard int"


def read_file_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root) and content of every file below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + "/" + root.split("://")[-1].removeprefix("file:").strip("/") + "/", "")
    return files.select(below.alias("path"), "content")


def write_file_tree(files: DataFrame, path: str) -> None:
    """path and content as a Parquet table: many small files do not serve a cluster."""
    files.select("path", "content").write.option("compression", "zstd").parquet(path)


def read_case_corpus(files: DataFrame, extensions: list[str]) -> DataFrame:
    """files (path, content) -> one row a case with base, left, right, expected; only cases with all four. path_name is what
    final_path says, else file_name, else file.<extension>."""
    located = locate_case(files, extensions)
    pivoted = located.groupBy("case_id", "extension").pivot("file", [*CASE_FILES, *CASE_NOTES]).agg(F.first("content"))
    whole = pivoted.where(" AND ".join(f"{c} IS NOT NULL" for c in CASE_FILES))
    parts = F.split("case_id", "/")
    said = lambda c: F.regexp_replace(F.decode(c, "utf-8"), r"(?U)^\s+|\s+$", "")
    size = F.octet_length("Base") + F.octet_length("Left") + F.octet_length("Right")
    return whole.select(
        "case_id", F.concat_ws("/", parts[1], parts[2]).alias("repository"), "extension", F.coalesce(said("final_path"), said("file_name"), F.concat(F.lit("file."), "extension")).alias("path_name"),
        F.col("Base").alias("base"), F.col("Left").alias("left"), F.col("Right").alias("right"), F.col("Expected").alias("expected"), size.cast("long").alias("estimated_input_bytes"),
    )


def write_manifest(cases: DataFrame, path: str) -> None:
    cases.select("case_id", "repository", "extension", "path_name", "estimated_input_bytes", "shard").write.partitionBy("shard").json(path)


def read_manifest(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """The manifest, or one shard of it (only that shard's folder is read)."""
    rows = spark.read.schema(MANIFEST).json(path)
    return rows if shard is None else rows.where(F.col("shard") == shard)


def pending_cases(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Cases of the manifest that no result names."""
    return manifest.join(done.select("case_id"), "case_id", "left_anti")


def repair_results(lines: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, legacy) of result lines (value: JSON): undecodable lines are dropped; a result is valid if it is
    oversize or both its output artifacts exist (artifacts: path; the line's own_artifact and other_artifact)."""
    schema = "case_id string, status string, own_artifact string, other_artifact string"
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("case_id IS NOT NULL")
    there = lambda n: artifacts.select(F.col("path").alias(f"{n}_artifact")).distinct().withColumn(n, F.lit(True))
    joined = rows.join(there("own"), "own_artifact", "left").join(there("other"), "other_artifact", "left")
    good = (F.col("status") == "oversize") | (F.coalesce("own", F.lit(False)) & F.coalesce("other", F.lit(False)))
    out = joined.withColumn("valid", F.coalesce(good, F.lit(False))).drop("own", "other")
    return out.where("valid").drop("valid"), out.where("NOT valid").drop("valid")


_analyzers: dict[str, Callable[[DataFrame], DataFrame]] = {}
_handlers: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_analyzer(family: str, analyze: Callable[[DataFrame], DataFrame]) -> None:
    """analyze: documents (case_id, family, text) -> owners (case_id, owner_id, start_byte, end_byte, start_line, end_line)."""
    _analyzers[family] = analyze


def analyze(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(owners, violations) of documents by the analyzers of their families; unknown families are violations."""
    owners = None
    for family, fn in sorted(_analyzers.items()):
        part = fn(docs.where(F.col("family") == family)).select("case_id", "owner_id", "start_byte", "end_byte", "start_line", "end_line")
        owners = part if owners is None else owners.unionByName(part)
    unknown = docs.where(~F.col("family").isin(*_analyzers)) if _analyzers else docs
    told = unknown.select("case_id", F.lit(None).cast("string").alias("owner_id"), F.lit("unknown_family").alias("violation"))
    if owners is None:
        return docs.sparkSession.createDataFrame([], "case_id long, owner_id string, start_byte long, end_byte long, start_line int, end_line int"), told
    faults = validate_owners(owners)
    return owners.join(faults.select("case_id").distinct(), "case_id", "left_anti"), faults.unionByName(told)


def register_handler(handler_id: str, handle: Callable[[DataFrame], DataFrame]) -> None:
    """handle: cases (case_id, ...) -> case_id, resolved, output, diagnostic."""
    _handlers[handler_id] = handle


def run_handlers(cases: DataFrame) -> DataFrame:
    """cases (case_id, handler_id, ...) through their handlers; an unknown handler leaves a case unresolved."""
    out = cases.where(~F.col("handler_id").isin(*_handlers) | F.col("handler_id").isNull()) if _handlers else cases
    out = out.select("case_id", F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("output"), F.concat(F.lit("unknown handler: "), F.coalesce("handler_id", F.lit(""))).alias("diagnostic"))
    for handler_id, fn in sorted(_handlers.items()):
        out = out.unionByName(fn(cases.where(F.col("handler_id") == handler_id)).select("case_id", "resolved", "output", "diagnostic"))
    return out
