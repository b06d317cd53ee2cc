"""Tables between steps of a job, in the folder of spark.checkpoint.dir that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table that was written and is read back: cuts the lineage and survives lost executors.

    It is joined as shuffled() says. Where spark.checkpoint.dir is unset a local session gets a fresh folder; on a cluster that is an error."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return shuffled(spark.read.schema(df.schema).parquet(path))


def shuffled(df: DataFrame) -> DataFrame:
    """df, whose next join is one of shuffles and sorts.

    Else Spark tells a table's size by the packed bytes of its files, and sends rows that take many times those through the driver's
    memory to all executors. A side that is small at any size of the input is told by F.broadcast(), which goes before this."""
    return df.hint("merge")


#: Rows of a partition that windows and sorts hold at once in one task.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys, one partition for each ROWS_A_TASK of about rows rows, so that a task's memory does not grow with the input.

    Spark would join partitions up to a size in packed bytes, and rows that pack well take many times that in a window's sort."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
