"""Batches of puts and deletes as a mutation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def puts(rows: DataFrame) -> DataFrame:
    """(key, val, seq) as mutations: an insert or an overwrite."""
    return rows.select("key", "val", F.lit(False).alias("tombstone"), "seq")


def deletes(rows: DataFrame) -> DataFrame:
    """(key, seq) as tombstones."""
    return rows.select("key", F.lit(None).cast("string").alias("val"), F.lit(True).alias("tombstone"), "seq")


def validated_deletes(log: DataFrame) -> DataFrame:
    """Deletes with accepted: whether the key was live just before. A second delete of a dead key is rejected."""
    before = F.lag("tombstone").over(Window.partitionBy("key").orderBy("seq"))
    return log.withColumn("accepted", F.coalesce(~before, F.lit(False))).where("tombstone").select("key", "seq", "accepted")
