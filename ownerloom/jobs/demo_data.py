"""Revisions, documents and entries derived from the given tables; the same rules as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Owner revisions of a customer's orders, in SQL that Spark and DuckDB both run over a view `orders`.
OWNERS_SQL = """
SELECT 'base' AS role, o_custkey AS case_id, o_orderkey AS owner_id, 'p' AS path, o_orderkey AS pos, concat(o_orderpriority, '|', o_orderstatus) AS text
FROM orders WHERE o_orderkey % 13 <> 0
UNION ALL
SELECT 'ours', o_custkey, o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 'q' ELSE 'p' END, o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN concat(o_orderpriority, '|', o_orderstatus, '|A') ELSE concat(o_orderpriority, '|', o_orderstatus) END
FROM orders WHERE (o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0) OR (o_orderkey % 13 = 0 AND o_orderkey % 2 = 0)
UNION ALL
SELECT 'theirs', o_custkey, o_orderkey, 'p', o_orderkey,
  CASE WHEN o_orderkey % 154 = 0 THEN concat(o_orderpriority, '|', o_orderstatus, '|A')
       WHEN o_orderkey % 7 = 0 THEN concat(o_orderpriority, '|', o_orderstatus, '|B')
       WHEN o_orderkey % 13 = 0 AND o_orderkey % 5 = 0 THEN concat(o_orderpriority, '|', o_orderstatus, '|T')
       ELSE concat(o_orderpriority, '|', o_orderstatus) END
FROM orders WHERE (o_orderkey % 13 <> 0 AND o_orderkey % 19 <> 0) OR (o_orderkey % 13 = 0 AND o_orderkey % 3 = 0)
"""


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, role, owner_id, path, pos, text, fingerprint of three revisions of every customer's orders."""
    orders = table(spark, sf_dir, "orders")
    sql = OWNERS_SQL.replace("FROM orders", "FROM {orders}")
    return spark.sql(sql, orders=orders).withColumn("fingerprint", F.md5("text"))


def revision(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    return owners(spark, sf_dir).where(F.col("role") == role).drop("role")


#: The owners as a CTE for oracle SQL.
OWNERS_CTE = f"owners AS (SELECT *, md5(text) AS fingerprint FROM ({OWNERS_SQL}) o)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line (from 1) and text of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("line"), "text")


LINES_CTE = """l0 AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS text FROM l0)"""
