"""Queries that write: stores and binary files in the shared folder, read back, and the SQL that each must equal.

Each run has a new folder below spark.checkpoint.dir, which stays until that folder is cleaned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import workload
from ..operators import compact, flush
from ..schema import EngineConfig, MANIFEST
from ..sources import codec
from ..sources.store import Store, shared_folder
from .registry import query
from .views import SEGMENT, m_events, m_orders, mix_tables, order_tables, read

_LIVE = "SELECT key, arg_max({'val': val, 'tombstone': tombstone}, seq) AS last FROM m_orders GROUP BY key"


def _store(spark: SparkSession, name: str, **options) -> Store:
    return Store(spark, EngineConfig(shared_folder(spark, name), **options))


def _loaded(spark: SparkSession, d: str, **options) -> Store:
    """m_orders as three batches, the later numbers later, compacted between the last two."""
    store, log = _store(spark, "orders", table_entries=5000, **options), m_orders(spark, d)
    ends = log.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    low, span = ends["low"], (ends["high"] - ends["low"]) // 3 + 1
    for k in range(3):
        store.write_batch(log.where(F.col("seq").between(low + k * span, low + (k + 1) * span - 1)))
        if k == 1:
            store.compact()
    return store


@query(f"SELECT key, last.val AS val FROM ({_LIVE}) WHERE NOT last.tombstone", "m_orders")
def store_batches_reopened(spark: SparkSession, d: str) -> DataFrame:
    """Batches, a compaction, another batch; then the store is opened anew and scanned."""
    return Store(spark, _loaded(spark, d).config).scan()


@query(f"SELECT key, last.val AS val FROM ({_LIVE}) WHERE NOT last.tombstone", "m_orders")
def store_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The same after all levels have gone to the last one, where tombstones are collected, and old folders are deleted."""
    store = _loaded(spark, d, gc_tombstones=True)
    store.compact()
    store.vacuum()
    return Store(spark, store.config).scan()


@query(f"SELECT 3 AS level, count(*) AS entries, true AS stamped, true AS disjoint FROM ({_LIVE})", "m_orders")
def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What the manifest says after a full compaction: one level, every key once, tombstones too, times of the clock."""
    store = _loaded(spark, d)
    store.compact()
    rows = spark.createDataFrame([(t["file_number"], t["level"], t["ts_ms"], t["min_key"], t["max_key"], t["n_entries"]) for t in store.manifest], MANIFEST)
    clock = F.unix_millis(F.current_timestamp())
    fresh = F.col("ts_ms").between(clock - 86_400_000, clock + 86_400_000)
    sums = rows.groupBy("level").agg(F.sum("n_entries").alias("entries"), F.every(fresh).alias("stamped"))
    return sums.join(compact.permitted(rows).select("level", F.col("allowed").alias("disjoint")), "level")


@query(
    """SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, last.val IS NOT NULL AS success,
CASE WHEN last.val IS NOT NULL THEN '' ELSE 'Key does not exist' END AS message, last.val AS data FROM customer LEFT JOIN """
    + f"({_LIVE}) o ON o.key = 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AND NOT last.tombstone",
    "m_orders",
)
def store_multi_get(spark: SparkSession, d: str) -> DataFrame:
    """Lookups of all customers in a store of several levels."""
    keys = read(spark, d, "customer").select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key"))
    return _loaded(spark, d).multi_get(keys)


@query("SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS val FROM nation WHERE n_regionkey <> 0")
def store_log_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Single puts and deletes, flushed whenever the memtable is full; the rest is replayed from the log on opening."""
    store = _store(spark, "nations", memtable_capacity=10)
    rows = read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale
    for r in rows:
        store.put(r["n_name"], str(r["n_nationkey"]))
    for r in rows:
        if r["n_regionkey"] == 0:
            store.delete(r["n_name"])
    return Store(spark, store.config).scan()


_SAID = (
    ("'PUT region-' || r_regionkey || ' ' || r_regionkey", "true", "'OK'", "NULL"),
    ("'get region-' || r_regionkey", "true", "''", "CAST(r_regionkey AS VARCHAR)"),
    ("'Put region-' || r_regionkey || ' new more'", "true", "'OK'", "NULL"),
    ("'COMPACT'", "true", "''", "NULL"),
    ("'GET region-' || r_regionkey", "true", "''", "'new'"),
    ("'del region-' || r_regionkey", "true", "'OK'", "NULL"),
    ("'del region-' || r_regionkey", "false", "'Failed to DELETE key: Cannot DELETE: key does not exist'", "NULL"),
    ("'get region-' || r_regionkey", "false", "'Key does not exist'", "NULL"),
    ("'put region-' || r_regionkey", "false", "'Usage: PUT <key> <value>'", "NULL"),
)


@query(" UNION ALL ".join(f"SELECT CAST(r_regionkey * {len(_SAID)} + {k} AS BIGINT) AS n, {line} AS line, {good} AS success, {text} AS message, CAST({data} AS VARCHAR) AS data FROM region" for k, (line, good, text, data) in enumerate(_SAID)))
def store_session(spark: SparkSession, d: str) -> DataFrame:
    """Lines of commands, one after another; what follows EXIT is not run."""
    store, lines = _store(spark, "session"), []
    for r in read(spark, d, "region").orderBy("r_regionkey").collect():  # 5 rows at any scale
        name = f"region-{r['r_regionkey']}"
        lines += [f"PUT {name} {r['r_regionkey']}", f"get {name}", f"Put {name} new more", "COMPACT", f"GET {name}", f"del {name}", f"del {name}", f"get {name}", f"put {name}"]
    said = store.session([*lines, "exit", "put late 1"])
    rows = [(n, line, r["success"], r["message"], r["data"]) for n, (line, r) in enumerate(zip(lines, said, strict=True))]
    return spark.createDataFrame(rows, "n bigint, line string, success boolean, message string, data string")


_TIMED = "SELECT tables.file_number, key, val, tombstone, m.ts AS ts FROM tables JOIN (SELECT file_number, max(seq) AS ts FROM tables GROUP BY 1) m ON tables.file_number = m.file_number"


@query(_TIMED, "m_orders", "tables")
def table_files_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Binary table files, written by the tasks and read back."""
    folder = shared_folder(spark, "tables")
    codec.write_tables(order_tables(spark, d), folder).agg(F.sum("bytes")).collect()
    return codec.open_tables(spark, f"{folder}/table-*").select("file_number", "key", "val", "tombstone", "ts")


@query("SELECT key, val, tombstone, seq // 128 AS segment, row_number() OVER (PARTITION BY seq // 128 ORDER BY seq) - 1 AS place FROM m_events", "m_events")
def log_files_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Binary log files, written by the tasks and read back in order."""
    folder = shared_folder(spark, "log")
    codec.write_log(m_events(spark, d), F.floor(F.col("seq") / SEGMENT), folder).agg(F.sum("bytes")).collect()
    return codec.open_log(spark, f"{folder}/wal-*").select("key", "val", "tombstone", "segment", "place")


@query("SELECT level, file_number, count(*) AS n_entries, min(key) AS min_key, max(key) AS max_key FROM tables WHERE level <= 1 GROUP BY 1, 2", "m_orders", "tables")
def levels_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Table files in a folder for each level, found by their names, up to level 1."""
    folder = shared_folder(spark, "levels")
    codec.write_levels(order_tables(spark, d), folder).agg(F.sum("bytes")).collect()
    rows = codec.open_levels(spark, folder, 1).groupBy("level", "file_number")
    return rows.agg(F.count("*").alias("n_entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("SELECT CAST(sum(9 + octet_length(encode(key)) + CASE WHEN tombstone THEN 0 ELSE octet_length(encode(coalesce(val, ''))) END) + 16 * count(DISTINCT file_number) AS BIGINT) AS bytes FROM tables", "m_orders", "tables")
def directory_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of all binary table files of a folder."""
    folder = shared_folder(spark, "bytes")
    codec.write_tables(order_tables(spark, d), folder).agg(F.sum("bytes")).collect()
    return workload.directory_size(spark, folder)


@query(
    """, seen AS (SELECT level, min_key, max(max_key) OVER (PARTITION BY level ORDER BY min_key, max_key, file_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM manifest)
SELECT level, count(*) AS n_tables, count(*) FILTER (WHERE min_key <= before) AS n_overlapping, level = 0 OR count(*) FILTER (WHERE min_key <= before) = 0 AS allowed FROM seen GROUP BY level""",
    "mix",
    "groups",
)
def level_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return compact.permitted(flush.metadata(mix_tables(spark, d)))
