"""Bloom filters of tables, to skip those that can't hold a key: rows (table, bit), or one bitmap for each table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cuts, range_of

BITS, HASHES, WORD = 1000, 7, 64
#: Keys that meet tables together; keys and ends of tables that one task sorts.
STRETCH, RANGE = 256, 50_000


def positions(key: Column) -> Column:
    """The bits of a key: md5 of the key with each number after it, mod the size."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda i: F.conv(F.substring(F.md5(F.concat(key, i.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long") % BITS)


def bits(tables: DataFrame) -> DataFrame:
    return tables.select("file_number", F.explode(positions(F.col("key"))).alias("bit")).distinct()


def filters(tables: DataFrame) -> DataFrame:
    """(file_number, filter): 16 words of 64 bits for each table. Words are summed up in every task before they are sent."""
    rows = tables.select("file_number", F.explode(positions(F.col("key"))).alias("bit"))
    word, bit = F.floor(F.col("bit") / WORD).cast("int"), F.pmod(F.col("bit"), F.lit(WORD)).cast("int")
    words = rows.groupBy("file_number", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    known = F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known")
    full = F.transform(F.sequence(F.lit(0), F.lit((BITS - 1) // WORD)), lambda k: F.coalesce(F.element_at("known", k), F.lit(0).cast("long")))
    return words.groupBy("file_number").agg(known).select("file_number", full.alias("filter"))


def holds(bitmap: Column, places: Column) -> Column:
    """Whether all these bits are set."""
    word = lambda p: F.element_at(bitmap, (F.floor(p / WORD) + 1).cast("int"))
    return F.forall(places, lambda p: F.call_function("shiftright", word(p), F.pmod(p, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


def _placed(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys (kind 1) and the ends of tables (kinds 0 and 2) with n, the number of keys up to there in the order of all keys: a
    running count in each range, and the sum of the ranges before."""
    ends = F.array(*[F.struct(F.col(c).alias("key"), F.lit(kind).alias("kind")) for c, kind in (("min_key", 0), ("max_key", 2))])
    points = keys.select("key", F.lit(1).alias("kind")).unionByName(manifest.select("file_number", F.inline(ends)), allowMissingColumns=True).where("key IS NOT NULL")
    points = points.withColumn("range", range_of(F.col("key"), cuts(points, "key", RANGE)))
    sizes = points.groupBy("range").agg(F.count(F.when(F.col("kind") == 1, 1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.count(F.when(F.col("kind") == 1, 1)).over(Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("n", local).join(F.broadcast(sizes.select("range", before.alias("before"))), "range").withColumn("n", F.col("n") + F.col("before"))


def may_contain(filters: DataFrame, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, file_number) of the tables that may hold the key: it is in their range and all its bits are set. Never misses
    one that does. Keys in order are cut into stretches of equal size, and a table meets those that its range touches: all
    but the first and last lie inside it, so the pairs compared are those in range and at most 2 * STRETCH a table. Rows of the
    manifest with one number are one table, as in the filters."""
    placed = _placed(manifest, keys)
    stretch = lambda n: F.floor(n / STRETCH)
    hashed = placed.where("kind = 1").select("key", positions(F.col("key")).alias("places"), stretch(F.col("n") - 1).alias("stretch"))
    ends = [f(F.when(F.col("kind") == kind, F.col(c))).alias(name) for f, kind, c, name in ((F.min, 0, "key", "min_key"), (F.max, 2, "key", "max_key"), (F.min, 0, "n", "first"), (F.max, 2, "n", "end"))]
    spans = placed.where("kind <> 1").groupBy("file_number").agg(*ends).where("first < end")
    spans = spans.withColumn("stretch", F.sequence(stretch(F.col("first")), stretch(F.col("end") - 1)))
    tables = spans.join(filters, "file_number").select("file_number", "min_key", "max_key", "filter", F.explode("stretch").alias("stretch"))
    inside = (F.col("key") >= F.col("min_key")) & (F.col("key") <= F.col("max_key"))
    return hashed.join(tables, "stretch").where(inside & holds(F.col("filter"), F.col("places"))).select("key", "file_number")


def has(bitmap: list[int], key: str) -> bool:
    """The same test for one key and table."""
    places = (int(hashlib.md5(f"{key}{i}".encode()).hexdigest()[:15], 16) % BITS for i in range(HASHES))
    return all(bitmap[p // WORD] >> (p % WORD) & 1 for p in places)
