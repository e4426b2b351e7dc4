"""The driver's tables as mutation logs and leveled tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flush import fixed_segments, flushed
from ..operators.mutations import deletes, puts

SEGMENT = 128


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _log(key, seq, val, tombstone) -> list:
    return [key.alias("key"), F.when(~tombstone, val).alias("val"), tombstone.alias("tombstone"), seq.cast("long").alias("seq")]


def _padded(prefix: str, column: str, width: int):
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def m_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(*_log(_padded("u", "user_id", 6), F.col("event_id"), F.col("props"), F.col("event_type") == "error"))


def m_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(*_log(_padded("c", "o_custkey", 8), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F"))


def mix_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that overlap in part: puts in tables of level 1, overwrites and deletes in newer ones of level 0."""
    part = read(spark, sf_dir, "part").withColumn("key", _padded("k", "p_partkey", 15)).withColumn("pk", F.col("p_partkey"))
    base = puts(part.select("key", F.col("p_name").alias("val"), F.col("pk").alias("seq"))).withColumn("file_number", F.floor(F.col("seq") / 128))
    again = part.where("pk % 10 = 0 AND floor(pk / 130) % 3 = 0")
    again = puts(again.select("key", F.col("p_brand").alias("val"), (1000000 + F.col("pk")).alias("seq"))).withColumn("file_number", 1000000 + F.floor((F.col("seq") - 1000000) / 130))
    gone = part.where("pk % 10 = 5 AND floor(pk / 130) % 5 = 0")
    gone = deletes(gone.select("key", (2000000 + F.col("pk")).alias("seq"))).withColumn("file_number", 2000000 + F.floor((F.col("seq") - 2000000) / 130))
    rows = base.withColumn("level", F.lit(1)).unionByName(again.withColumn("level", F.lit(0))).unionByName(gone.withColumn("level", F.lit(0)))
    return rows.select("key", "val", "tombstone", F.col("file_number").cast("long").alias("file_number"), "level", F.col("seq").cast("long").alias("seq"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m_orders flushed every SEGMENT numbers; the newest third of the tables is level 0, the oldest level 2."""
    tables = flushed(fixed_segments(m_orders(spark, sf_dir), SEGMENT))
    newest = tables.agg(F.max("file_number").alias("_top"))
    third = F.when(F.col("file_number") * 3 > 2 * F.col("_top"), 0).when(F.col("file_number") * 3 > F.col("_top"), 1).otherwise(2)
    return tables.crossJoin(F.broadcast(newest)).withColumn("level", third).drop("_top")


SQL = {
    "m_events": "m_events AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type <> 'error' THEN props END AS val, event_type = 'error' AS tombstone, event_id AS seq FROM events)",
    "m_orders": "m_orders AS (SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS key, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS val, o_orderstatus = 'F' AS tombstone, o_orderkey AS seq FROM orders)",
    "mix": """p AS (SELECT 'k' || lpad(CAST(p_partkey AS VARCHAR), 15, '0') AS key, p_partkey AS pk, p_name, p_brand FROM part),
mix AS (
  SELECT key, p_name AS val, false AS tombstone, pk // 128 AS file_number, 1 AS level, pk AS seq FROM p
  UNION ALL SELECT key, p_brand, false, 1000000 + pk // 130, 0, 1000000 + pk FROM p WHERE pk % 10 = 0 AND (pk // 130) % 3 = 0
  UNION ALL SELECT key, NULL, true, 2000000 + pk // 130, 0, 2000000 + pk FROM p WHERE pk % 10 = 5 AND (pk // 130) % 5 = 0)""",
    "tables": """flushed AS (SELECT seq // 128 AS file_number, key, arg_max({'val': val, 'tombstone': tombstone}, seq) AS last, max(seq) AS seq FROM m_orders GROUP BY 1, 2),
tables AS (SELECT key, last.val AS val, last.tombstone AS tombstone, file_number, CASE WHEN file_number * 3 > 2 * (SELECT max(file_number) FROM flushed) THEN 0
  WHEN file_number * 3 > (SELECT max(file_number) FROM flushed) THEN 1 ELSE 2 END AS level, seq FROM flushed)""",
    "groups": """manifest AS (SELECT file_number, level, min(key) AS min_key, max(key) AS max_key, max(seq) AS ts_ms, count(*) AS n_entries FROM mix GROUP BY 1, 2),
reach AS (SELECT *, max(max_key) OVER (ORDER BY min_key, max_key, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM manifest),
groups AS (SELECT *, sum(CASE WHEN pe IS NULL OR min_key > pe THEN 1 ELSE 0 END) OVER (ORDER BY min_key, max_key, file_number ROWS UNBOUNDED PRECEDING) AS grp FROM reach)""",
}
