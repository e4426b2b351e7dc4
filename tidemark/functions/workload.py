"""Generated workloads and their measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def padded_key(number):
    return F.concat(F.lit("k"), F.lpad(number.cast("string"), 15, "0"))


def value(number, size: int):
    """`size` times x, the first eight characters coded from the number, three bits further each."""
    head = F.concat(*[F.char(97 + F.shiftright(number, 3 * b).bitwiseAND(15)) for b in range(8)])
    return F.substring(F.concat(head, F.repeat(F.lit("x"), max(0, size - 8))), 1, size)


def load(spark: SparkSession, n: int, size: int = 64) -> DataFrame:
    """n puts, an overwrite of every tenth key, a delete of the fifth in every ten."""
    ids = spark.range(n).withColumn("key", padded_key(F.col("id")))
    no = F.lit(False)
    first = ids.select("key", value(F.col("id"), size).alias("val"), no.alias("tombstone"), F.col("id").alias("seq"))
    again = ids.where("id % 10 = 0").select("key", value(F.col("id") + 1, size).alias("val"), no.alias("tombstone"), (n + F.col("id")).alias("seq"))
    gone = ids.where("id % 10 = 5").select("key", F.lit(None).cast("string").alias("val"), F.lit(True).alias("tombstone"), (2 * n + F.col("id")).alias("seq"))
    return first.unionByName(again).unionByName(gone)


def shuffled_keys(spark: SparkSession, n: int, seed: int = 1337) -> DataFrame:
    """The keys key-0 to key-(n-1) in a seeded order."""
    return spark.range(n).orderBy(F.rand(seed)).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"))


def payload(log: DataFrame) -> DataFrame:
    """Mutations and bytes of keys and values."""
    return log.agg(F.count("*").alias("ops"), F.sum(F.octet_length("key") + F.coalesce(F.octet_length("val"), F.lit(0))).cast("long").alias("bytes"))


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
