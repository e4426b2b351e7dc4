"""Compaction: overlap groups of tables, newest-wins merges, level by level.

The manifest, one row per table, is the only input of the unpartitioned window; entries are only joined and grouped by
key. Which tables take part is known before any entry is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flush import metadata


def overlap_groups(manifest: DataFrame) -> DataFrame:
    """manifest with grp: tables whose closed key ranges overlap, directly or through others, share a number."""
    order = Window.orderBy("min_key", "max_key", "file_number")
    reach = F.max("max_key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.withColumn("_new", (reach.isNull() | (F.col("min_key") > reach)).cast("int"))
    return starts.withColumn("grp", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def overlapping(manifest: DataFrame, probes: DataFrame) -> DataFrame:
    """Probe ranges (probe, lo, hi) with each table whose range overlaps theirs."""
    return probes.join(manifest, (F.col("min_key") <= F.col("hi")) & (F.col("max_key") >= F.col("lo"))).select("probe", "file_number")


def permitted(manifest: DataFrame) -> DataFrame:
    """(level, n_tables, n_overlapping, allowed): how many tables of a level start inside the range of one before them; only
    level 0 may have such tables. The window runs over one row per table."""
    order = Window.partitionBy("level").orderBy("min_key", "max_key", "file_number")
    inside = F.col("min_key") <= F.max("max_key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = manifest.withColumn("inside", F.coalesce(inside, F.lit(False)))
    rows = rows.groupBy("level").agg(F.count("*").alias("n_tables"), F.count_if("inside").alias("n_overlapping"))
    return rows.withColumn("allowed", (F.col("level") == 0) | (F.col("n_overlapping") == 0))


def merged(entries: DataFrame) -> DataFrame:
    """Entries with grp and key once per group: the lowest level's newest table wins; tombstones stay."""
    first = F.max_by(F.struct("val", "tombstone", "seq"), F.struct(-F.col("level"), F.col("file_number"))).alias("first")
    return entries.groupBy("grp", "key").agg(first).select("grp", "key", "first.val", "first.tombstone", "first.seq")


def merge_overlapping(tables: DataFrame) -> DataFrame:
    """The self-merge of one level: (grp, key, val, tombstone, seq)."""
    groups = overlap_groups(metadata(tables)).select("file_number", "level", "grp")
    return merged(tables.join(groups, ["file_number", "level"]))


def without_tables(manifest: DataFrame, dropped: DataFrame) -> DataFrame:
    return manifest.join(dropped.select("file_number"), "file_number", "left_anti")


def planned(manifest: DataFrame) -> DataFrame:
    """The manifest (file_number, level, min_key, max_key) before any step: where each table is (to_file, to_level), the
    key range there (low, high), and whether tombstones are collected there."""
    return manifest.select(
        "file_number", "level", F.col("file_number").alias("to_file"), F.col("level").alias("to_level"), F.col("min_key").alias("low"), F.col("max_key").alias("high"), F.lit(False).alias("collected")
    )


def step(plan: DataFrame, level: int, bottom: int | None = None, gc: bool = False) -> DataFrame:
    """The plan after level `level` has gone into the next one. Groups without a table of `level` stay as they are; each
    other group becomes one table with a number above all others. With gc, tombstones that reach `bottom` are collected:
    all older versions of their keys are in the merge or have the tombstone's table above them no more. Windows run over
    one row per table; no step reads an entry."""
    pair = F.col("to_level").isin(level, level + 1)
    order = Window.partitionBy("pair").orderBy("low", "high", "to_file")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = plan.withColumn("pair", pair).withColumn("new", (before.isNull() | (F.col("low") > before)).cast("int"))
    rows = rows.withColumn("grp", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    group = Window.partitionBy("pair", "grp")
    rows = rows.withColumn("moved", F.col("pair") & (F.min("to_level").over(group) == level))
    for name, value in (("low", F.min("low")), ("high", F.max("high"))):
        rows = rows.withColumn(f"{name}_", value.over(group))
    base = F.max("to_file").over(Window.partitionBy()) + 1
    moved = lambda new, old: F.when(F.col("moved"), new).otherwise(F.col(old)).alias(old)
    return rows.select(
        "file_number",
        "level",
        moved(base + F.col("grp"), "to_file"),
        moved(F.lit(level + 1), "to_level"),
        moved(F.col("low_"), "low"),
        moved(F.col("high_"), "high"),
        moved(F.lit(gc and level + 1 == bottom), "collected"),
    )


def carried_out(tables: DataFrame, plan: DataFrame) -> DataFrame:
    """The tables after a plan: each new table is merged once from all tables that went into it, on the way too, as the
    lowest level's newest table wins at every step; tables that stay are not shuffled."""
    rows = tables.join(plan.select("file_number", "level", "to_file", "to_level", "collected"), ["file_number", "level"])
    stays = (F.col("file_number") == F.col("to_file")) & (F.col("level") == F.col("to_level"))
    first = F.max_by(F.struct("val", "tombstone", "seq"), F.struct(-F.col("level"), F.col("file_number"))).alias("first")
    new = rows.where(~stays).groupBy("to_file", "to_level", "collected", "key").agg(first).where(~(F.col("collected") & F.col("first.tombstone")))
    new = new.select("key", "first.val", "first.tombstone", F.col("to_file").alias("file_number"), F.col("to_level").alias("level"), "first.seq")
    return rows.where(stays).select(*new.columns).unionByName(new)


def compact_into(tables: DataFrame, level: int, bottom: int | None = None, gc: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """All tables after one step; the manifest is derived from the tables where it is not given."""
    return carried_out(tables, step(planned(metadata(tables) if manifest is None else manifest), level, bottom, gc))


def cascade(tables: DataFrame, bottom: int, gc: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """All tables after every level down to `bottom` has gone into the next: all steps are planned on the manifest first,
    then entries are merged once."""
    plan = planned(metadata(tables) if manifest is None else manifest)
    for level in range(bottom):
        plan = step(plan, level, bottom, gc)
    return carried_out(tables, plan)


def oldest(manifest: DataFrame) -> DataFrame:
    """The table that a partial compaction takes first."""
    return manifest.orderBy("ts_ms", "file_number").limit(1)


def compact_oldest(tables: DataFrame, level: int) -> DataFrame:
    """Entries of the one table that replaces the oldest table of `level` and those of the next level that overlap it."""
    manifest = metadata(tables)
    first = oldest(manifest.where(F.col("level") == level))
    probe = first.select(F.lit(0).alias("probe"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    below = overlapping(manifest.where(F.col("level") == level + 1), probe).select("file_number")
    taken = first.select("file_number").unionByName(below).withColumn("grp", F.lit(1).cast("long"))
    pair = tables.where(F.col("level").isin(level, level + 1))
    return merged(pair.join(taken, "file_number")).drop("grp")
