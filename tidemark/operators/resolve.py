"""Which version of a key counts: the newest of a log, or the first level's newest table; tombstones end the search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MISS = "Key does not exist"


def latest_by_window(log: DataFrame) -> DataFrame:
    """The newest mutation of each key, by ranking."""
    newest = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def latest_by_agg(log: DataFrame) -> DataFrame:
    """The same by aggregation: partial results are combined before the shuffle, so hot keys cost little."""
    last = F.max_by(F.struct("val", "tombstone"), "seq").alias("last")
    return log.groupBy("key").agg(last, F.max("seq").alias("seq")).select("key", "last.val", "last.tombstone", "seq")


def live(entries: DataFrame) -> DataFrame:
    return entries.where(~F.col("tombstone"))


def precedence(tables: DataFrame) -> DataFrame:
    """The entry of each key that a search finds first: lowest level, then newest table. Tombstones stay."""
    first = F.max_by(F.struct("val", "tombstone", "level", "file_number"), F.struct(-F.col("level"), F.col("file_number"))).alias("first")
    return tables.groupBy("key").agg(first).select("key", "first.val", "first.tombstone", "first.level", "first.file_number")


def with_memtable(memtable: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with the memtable's entries in front, as level -1."""
    head = memtable.select("key", "val", "tombstone", F.lit(0).cast("long").alias("file_number"), F.lit(-1).alias("level"))
    return head.unionByName(tables.select("key", "val", "tombstone", "file_number", "level"))


def get(entries: DataFrame, key: str) -> DataFrame:
    """The live value of one key in resolved entries; no row for a miss."""
    return live(entries.where(F.col("key") == key)).select("key", "val")


def multi_get(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """A response for every requested key. The tables are cut to the requested keys before they are resolved; the join
    strategy follows the sizes."""
    wanted = keys.select("key").distinct()
    found = live(precedence(tables.join(wanted, "key", "left_semi"))).select("key", "val")
    rows = keys.join(found.withColumn("_hit", F.lit(True)), "key", "left")
    hit = F.col("_hit").isNotNull()
    return rows.select("key", hit.alias("success"), F.when(hit, "").otherwise(MISS).alias("message"), F.col("val").alias("data"))
