"""Document shards under size-tiered compaction, with a versioned manifest.

An arrival is appended as small immutable Parquet shards. Shards fall into tiers by size (each tier
FANOUT times the one below). When a tier holds FANOUT shards or more, its shards are merged in
groups up to the target size; every group is one task that streams its members record batch by
record batch into a new file, so nothing is shuffled and no group is held in memory. Shards at half
the target size or more are left alone, so a row is rewritten at most once a tier.

A version is a manifest table (written and committed by Spark) and a pointer file named by its
number, put in place by a rename that fails if the name is taken: readers see the old version or
the new one, and of two writers one must try again. Files of lost attempts are in no manifest.

Cases: rows are kept as they are, with all their columns, nulls, repeats and texts of any length (a row group of the
new file may then be larger than ROW_GROUP_BYTES by one batch); an empty arrival adds no shard but a version; one with
other columns than the store's is refused. Shards of equal size are taken in order of their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ownerloom.llm._common import file_system, scratch

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 4 << 20
FANOUT = 4
#: Arrivals in the registered query: more than fill a tier.
ARRIVALS = 5
#: Rows decoded at a time while merging, and bytes after which a row group of the new file ends.
BATCH_ROWS = 1024
ROW_GROUP_BYTES = 16 << 20
ENTRY = "path string, n_bytes long, n_rows long, tier int"


class ShardStore:
    """Shards of one table under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, smallest_bytes: int = SMALLEST_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.smallest_bytes = target_bytes, fanout, smallest_bytes

    # -- versions ----------------------------------------------------------------------------

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        folder = self._path(f"{self.root}/versions")
        fs = folder.getFileSystem(self._conf())
        if not fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Shards of a version (the latest by default): path, n_bytes, n_rows, tier."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self._pointer(version))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        paths = [r["path"] for r in self.manifest(version).select("path").collect()]  # names of files
        schema = self._schema()
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _commit(self, entries: DataFrame, based_on: int) -> int:
        """Make entries version based_on + 1; fails if another writer has made that version."""
        table = scratch(self.spark, "manifest").rsplit("/", 1)[-1]
        table = f"{self.root}/manifests/{table}"
        entries.select("path", "n_bytes", "n_rows", "tier").coalesce(1).write.parquet(table)
        self._put(f"{self.root}/versions/{based_on + 1:08d}", table)
        return based_on + 1

    def _put(self, path: str, text: str) -> None:
        """Create a small file whole or not at all; fails if it exists."""
        jvm, conf = self.spark._jvm, self._conf()
        final = self._path(path)
        fs = final.getFileSystem(conf)
        fs.mkdirs(final.getParent())
        draft = self._path(f"{self.root}/drafts/{scratch(self.spark, 'v').rsplit('/', 1)[-1]}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), none)

    def _pointer(self, version: int) -> str:
        return self.spark.read.text(f"{self.root}/versions/{version:08d}").first()[0]

    def _schema(self):
        from pyspark.sql.types import StructType

        path = self._path(f"{self.root}/schema/columns.json")
        if not path.getFileSystem(self._conf()).exists(path):
            return StructType()
        return StructType.fromJson(__import__("json").loads(self.spark.read.text(f"{self.root}/schema/columns.json").first()[0]))

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _tier(self, n_bytes):
        return F.greatest(F.lit(0), F.floor(F.log(float(self.fanout), F.greatest(n_bytes, F.lit(1)) / float(self.smallest_bytes)))).cast("int")

    # -- writes ------------------------------------------------------------------------------

    def append(self, rows: DataFrame) -> int:
        """Add an arrival: its partitions become shards, without a shuffle. Returns the new version."""
        based_on, schema = self.version(), rows.schema
        if (have := self._schema()).fields:
            if [(f.name, f.dataType) for f in have] != [(f.name, f.dataType) for f in schema]:
                raise ValueError("an arrival must have the store's columns")
        else:
            self._put(f"{self.root}/schema/columns.json", schema.json())
        folder = scratch(self.spark, "arrival").rsplit("/", 1)[-1]
        folder = f"{self.root}/shards/{folder}"
        rows.write.option("compression", "zstd").parquet(folder)
        files = self.spark.read.schema(schema).parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes"))
        entries = files.groupBy("path", "n_bytes").agg(F.count("*").alias("n_rows")).withColumn("tier", self._tier(F.col("n_bytes")))
        return self._commit(self.manifest(based_on).unionByName(entries), based_on)

    def plan(self, version: int | None = None) -> DataFrame:
        """Shards to merge: path, n_rows, tier and the group that becomes one file. File names only, no rows."""
        small = self.manifest(version).where(F.col("n_bytes") * 2 < self.target_bytes)
        tier = Window.partitionBy("tier")
        order = tier.orderBy("n_bytes", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        full = small.withColumn("in_tier", F.count("*").over(tier)).where(F.col("in_tier") >= self.fanout)
        # A group ends where the running size passes a multiple of the target less what a member may add.
        grouped = full.withColumn("slot", F.floor((F.sum("n_bytes").over(order) - 1) / F.lit(self.target_bytes)).cast("int"))
        members = Window.partitionBy("tier", "slot")
        return grouped.withColumn("members", F.count("*").over(members)).where("members > 1").select("path", "n_rows", "tier", F.concat_ws("-", "tier", "slot").alias("group"))

    def compact(self) -> int:
        """One pass over all tiers; returns the new version, or the present one if no tier is full."""
        based_on = self.version()
        todo = self.plan(based_on)
        groups = todo.groupBy("group").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sum("n_rows").alias("n_rows"))
        n_groups = groups.count()
        if not n_groups:
            return based_on
        folder = scratch(self.spark, "merged").rsplit("/", 1)[-1]
        folder = f"{self.root}/shards/{folder}"
        table = f"{folder}-files"
        groups.select("group", "paths", "n_rows").repartition(n_groups).mapInArrow(_merger(folder), "group string, path string, n_bytes long, n_rows long").write.parquet(table)
        merged = self.spark.read.parquet(table).withColumn("tier", self._tier(F.col("n_bytes")))
        kept = self.manifest(based_on).join(todo.select("path"), "path", "left_anti")
        return self._commit(kept.unionByName(merged.select("path", "n_bytes", "n_rows", "tier")), based_on)

    def compact_fully(self) -> int:
        """Passes until no tier is full: at most one a tier."""
        while (version := self.version()) != self.compact():
            pass
        return version

    def vacuum(self) -> int:
        """Delete shards of older versions that the latest no longer names; returns how many."""
        latest = self.version()
        if latest < 2:
            return 0
        # One read of the pointers and one of all manifests they name, however many versions there are.
        pointers = self.spark.read.text(f"{self.root}/versions/*").select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).cast("int").alias("version"))
        tables = [r["value"] for r in pointers.where(F.col("version") < latest).collect()]
        old = self.spark.read.schema(ENTRY).parquet(*tables).select("path").distinct()
        gone = [r["path"] for r in old.join(self.manifest(latest).select("path"), "path", "left_anti").collect()]  # names of files
        # Names of shards that an earlier vacuum deleted still stand in old manifests and count no more.
        return sum(where.getFileSystem(self._conf()).delete(where, False) for where in map(self._path, gone))


def _merger(folder: str):
    out_schema = pa.schema([("group", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64()), ("n_rows", pa.int64())])

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for group, paths, n_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, writer, rows, held, size = f"{folder}/group-{group}-{attempt}.parquet", None, 0, [], 0
                fs, inner = file_system(path)
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(inner, compression=None) as out:
                    for member in paths:
                        source_fs, source = file_system(member)
                        with source_fs.open_input_file(source) as stream:
                            shard = pq.ParquetFile(stream)
                            writer = writer or pq.ParquetWriter(out, shard.schema_arrow, compression="zstd")
                            for part in shard.iter_batches(BATCH_ROWS):
                                rows += part.num_rows
                                size += part.nbytes
                                held.append(part)
                                if size >= ROW_GROUP_BYTES:
                                    writer.write_table(pa.Table.from_batches(held))
                                    held, size = [], 0
                    if held:
                        writer.write_table(pa.Table.from_batches(held))
                    writer.close()
                if rows != n_rows:
                    raise ValueError(f"group {group} has {rows} rows, its shards have {n_rows}")
                yield pa.RecordBatch.from_pylist([{"group": group, "path": fs_uri(path), "n_bytes": fs.get_file_info(inner).size, "n_rows": rows}], schema=out_schema)

    return merge


def fs_uri(path: str) -> str:
    """The form in which Spark names a file: a scheme, and three slashes for local files."""
    if path.startswith("file:"):
        return "file:///" + path.removeprefix("file:").lstrip("/")
    return path if "://" in path else f"file://{path}"


def op10_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: documents in ARRIVALS arrivals, compacted, then every row as the last version has it, and
    whether it lies in a merged shard (all do where the whole table is smaller than a target file)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = ShardStore(spark, scratch(spark, "shards"))
    arrival = F.coalesce(F.pmod(F.col("doc_id"), F.lit(ARRIVALS)), F.lit(0))
    for k in range(ARRIVALS):
        store.append(docs.where(arrival == k))
    version = store.compact_fully()
    store.vacuum()
    rows = store.read(version)
    merged = F.contains(F.col("_metadata.file_path"), F.lit("/shards/merged-"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("text_bytes"), F.md5(F.encode("text", "utf-8")).alias("text_md5"), merged.alias("merged"))


#: Over tables smaller than a target file, where one pass merges every shard.
OP10_SQL = "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS text_bytes, md5(text) AS text_md5, true AS merged FROM documents"
