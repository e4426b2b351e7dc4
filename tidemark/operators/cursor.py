"""Table cursors as ordered DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan(entries: DataFrame) -> DataFrame:
    return entries.orderBy("key")


def seek_first(tables: DataFrame) -> DataFrame:
    return tables.groupBy("file_number").agg(F.min_by(F.struct("key", "val", "tombstone"), "key").alias("e")).select("file_number", "e.*")


def seek_last(tables: DataFrame) -> DataFrame:
    return tables.groupBy("file_number").agg(F.max_by(F.struct("key", "val", "tombstone"), "key").alias("e")).select("file_number", "e.*")


def seek(tables: DataFrame, key: str) -> DataFrame:
    """The entry of exactly this key in each table that has it; a cursor on any other key is not valid."""
    return tables.where(F.col("key") == key).select("file_number", "key", "val", "tombstone")


def following(tables: DataFrame) -> DataFrame:
    """Each entry with the key that the cursor moves to next; null at the end."""
    return tables.select("file_number", "key", F.lead("key").over(Window.partitionBy("file_number").orderBy("key")).alias("next_key"))


def entry_text(key="key", val="val", tombstone="tombstone"):
    return F.concat(F.lit("("), F.col(key), F.lit(", "), F.coalesce(F.col(val), F.lit("")), F.lit(", "), F.col(tombstone).cast("string"), F.lit(")"))


def rendered(tables: DataFrame) -> DataFrame:
    """Each table as one string in key order. All of a table meets in one row, as its string must."""
    rows = tables.groupBy("file_number").agg(F.sort_array(F.collect_list(F.struct("key", entry_text().alias("text")))).alias("rows"))
    return rows.select("file_number", F.concat(F.lit("SSTable["), F.array_join("rows.text", ", "), F.lit("]")).alias("text"))
