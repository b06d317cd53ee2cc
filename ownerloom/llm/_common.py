"""What the operators share: the shared scratch folder, files in it, and the training split."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local sessions (tests) get a fresh local one; on a
    cluster that would be another folder on each machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """The same as a table bucketed by key, so that a join on the key takes its rows as they lie. Spark knows buckets
    from a catalog only; the table's name is gone again at once, its files stay."""
    spark = df.sparkSession
    path = scratch(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    # A task that has one or two keys keeps their files open, and so its rows need not be sorted by bucket.
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "2"):
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """While it holds, the session has the setting; what is run in it must be an action."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> contextlib.AbstractContextManager[None]:
    """While it holds, Arrow batches of the session have at most rows rows: with whole texts, the usual 10,000 are
    tens of megabytes in the JVM and again in each Python worker. A smaller setting stays; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    return setting(spark, key, str(min(rows, now) if now > 0 else rows))


_worker_keeps: dict[str, dict] = {}


def worker_keeps(operator: str) -> dict:
    """What an operator keeps in this Python worker between tasks. Workers serve all stages of a session, so what another
    operator has kept goes when this one asks, and its memory goes back to the system."""
    others = [name for name in _worker_keeps if name != operator]
    for name in others:
        del _worker_keeps[name]
    if others:
        give_back()
    return _worker_keeps.setdefault(operator, {})


def give_back() -> None:
    """Free memory of this process goes back to the system: that of Arrow's pool, and of the C library where it can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def give_back_on_driver(spark: SparkSession) -> bool:
    """Free memory of the driver goes back to the system: what its JVM's compiler and libraries leave in the C library's
    heaps, outside the Java heap. False where the JVM does not know how."""
    from py4j.protocol import Py4JError

    give_back()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        out = new(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # The server's class is not open to reflection; its public interface is.
        kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        call.invoke(server, array(jvm.java.lang.Object, name, "systemTrimNativeHeap", new(jvm.java.lang.Object, 0), new(jvm.java.lang.String, 0)))
    except Py4JError:
        return False
    return True


def as_uri(path: str) -> str:
    """pyarrow wants a scheme; Spark's local paths may come without one."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def file_system(path: str):
    """(pyarrow filesystem, path in it) of a file in the shared folder: local, HDFS or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(as_uri(path))


def held_out(key: str = "doc_id") -> Column:
    """True for the third of the rows that no model learns from. A null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def unit_hash(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the row's values alone, for reproducible bounded samples."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def manifest_json(spark: SparkSession, path: str) -> dict:
    """One small JSON file read through Spark."""
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
