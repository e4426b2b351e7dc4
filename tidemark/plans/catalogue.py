"""The queries over the driver's tables as logs and tables, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, workload
from ..operators import bloom, compact, cursor, flush, mutations, resolve
from ..sources import codec
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .views import SEGMENT, m_events, m_orders, mix_tables, order_tables, read

_LATEST = "(SELECT key, arg_max({'val': val, 'tombstone': tombstone}, seq) AS last, max(seq) AS seq FROM m_events GROUP BY key)"
_LATEST_ROWS = f"SELECT key, last.val AS val, last.tombstone AS tombstone, seq FROM {_LATEST}"


@query(_LATEST_ROWS, "m_events")
def latest_state_window(spark: SparkSession, d: str) -> DataFrame:
    return resolve.latest_by_window(m_events(spark, d))


@query(_LATEST_ROWS, "m_events")
def latest_state_agg(spark: SparkSession, d: str) -> DataFrame:
    return resolve.latest_by_agg(m_events(spark, d))


@query(f"SELECT key, last.val AS val FROM {_LATEST} WHERE NOT last.tombstone ORDER BY key", "m_events")
def scan_ordered(spark: SparkSession, d: str) -> DataFrame:
    return cursor.scan(resolve.live(resolve.latest_by_agg(m_events(spark, d))).select("key", "val"))


@query(f"SELECT key, last.val AS val FROM {_LATEST} WHERE NOT last.tombstone AND key = 'u000007'", "m_events")
def get_point(spark: SparkSession, d: str) -> DataFrame:
    log = m_events(spark, d).where("key = 'u000007'")
    return resolve.get(resolve.latest_by_agg(log), "u000007")


@query("SELECT key, val FROM m_events WHERE key = 'nobody'", "m_events")
def get_missing(spark: SparkSession, d: str) -> DataFrame:
    return resolve.get(resolve.latest_by_agg(m_events(spark, d).where("key = 'nobody'")), "nobody")


_FIRST = "first AS (SELECT key, arg_max({'val': val, 'tombstone': tombstone, 'level': level, 'file_number': file_number}, -level * 1000000000 + file_number) AS e FROM tables GROUP BY key)"


@query(
    f""", {_FIRST}, keys AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key FROM customer)
SELECT keys.key, e.val IS NOT NULL AS success, CASE WHEN e.val IS NOT NULL THEN '' ELSE 'Key does not exist' END AS message, e.val AS data
FROM keys LEFT JOIN (SELECT * FROM first WHERE NOT e.tombstone) f ON keys.key = f.key""",
    "m_orders",
    "tables",
)
def multi_get_response(spark: SparkSession, d: str) -> DataFrame:
    keys = read(spark, d, "customer").select(F.concat(F.lit("c"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key"))
    return resolve.multi_get(keys, order_tables(spark, d))


@query(f"SELECT key, seq FROM {_LATEST} WHERE last.tombstone", "m_events")
def tombstones_current(spark: SparkSession, d: str) -> DataFrame:
    return resolve.latest_by_agg(m_events(spark, d)).where("tombstone").select("key", "seq")


@query("SELECT count(*) AS shadowed FROM m_events e JOIN (SELECT key, max(seq) AS seq FROM m_events WHERE tombstone GROUP BY key) t ON e.key = t.key WHERE NOT e.tombstone AND e.seq < t.seq", "m_events")
def delete_shadow(spark: SparkSession, d: str) -> DataFrame:
    log = m_events(spark, d)
    last = log.where("tombstone").groupBy("key").agg(F.max("seq").alias("dead_at"))
    return log.where("NOT tombstone").join(last, "key").where("seq < dead_at").agg(F.count("*").alias("shadowed"))


@query(
    "SELECT key, seq, coalesce(NOT b, false) AS accepted FROM (SELECT *, lag(tombstone) OVER (PARTITION BY key ORDER BY seq) AS b FROM m_events) WHERE tombstone", "m_events"
)
def delete_validation(spark: SparkSession, d: str) -> DataFrame:
    return mutations.validated_deletes(m_events(spark, d))


@query(f"SELECT count(*) AS live_keys, (SELECT count(DISTINCT key) FROM m_events) AS keys FROM {_LATEST} WHERE NOT last.tombstone", "m_events")
def live_key_count(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.latest_by_agg(m_events(spark, d))
    return rows.agg(F.count(F.when(~F.col("tombstone"), 1)).alias("live_keys"), F.count("*").alias("keys"))


@query(
    f""", cut AS (SELECT max(seq) - 500 AS edge FROM m_orders),
mem AS (SELECT key, arg_max({{'val': val, 'tombstone': tombstone}}, seq) AS last FROM m_orders, cut WHERE seq > edge GROUP BY key),
old AS (SELECT key, arg_max({{'val': val, 'tombstone': tombstone}}, seq) AS last FROM m_orders, cut WHERE seq <= edge GROUP BY key)
SELECT coalesce(mem.key, old.key) AS key, CASE WHEN mem.key IS NOT NULL THEN mem.last.val ELSE old.last.val END AS val, mem.key IS NOT NULL AS from_memory
FROM mem FULL JOIN old ON mem.key = old.key WHERE NOT CASE WHEN mem.key IS NOT NULL THEN mem.last.tombstone ELSE old.last.tombstone END""",
    "m_orders",
)
def memtable_over_storage(spark: SparkSession, d: str) -> DataFrame:
    log = m_orders(spark, d)
    cut = log.agg((F.max("seq") - 500).alias("at"))
    log = log.crossJoin(F.broadcast(cut))
    memory = resolve.latest_by_agg(log.where("seq > at"))
    stored = flush.flushed(flush.fixed_segments(log.where("seq <= at").drop("at"), SEGMENT))
    rows = resolve.live(resolve.precedence(resolve.with_memtable(memory, stored)))
    return rows.select("key", "val", (F.col("level") == -1).alias("from_memory"))


@query("SELECT file_number, key, last.val AS val, last.tombstone AS tombstone, seq FROM flushed", "m_orders", "tables")
def flush_tables(spark: SparkSession, d: str) -> DataFrame:
    return flush.flushed(flush.fixed_segments(m_orders(spark, d), SEGMENT)).drop("level")


@query("SELECT file_number, level, max(seq) AS ts_ms, min(key) AS min_key, max(key) AS max_key, count(*) AS n_entries FROM tables GROUP BY 1, 2", "m_orders", "tables")
def table_metadata(spark: SparkSession, d: str) -> DataFrame:
    return flush.metadata(order_tables(spark, d))


@query("SELECT file_number, count(*) AS n FROM tables GROUP BY 1", "m_orders", "tables")
def table_size(spark: SparkSession, d: str) -> DataFrame:
    return order_tables(spark, d).groupBy("file_number").agg(F.count("*").alias("n"))


@query("SELECT file_number, min(key) AS key, arg_min(val, key) FILTER (WHERE NOT tombstone OR tombstone) AS val, arg_min(tombstone, key) AS tombstone FROM mix GROUP BY 1", "mix")
def seek_first(spark: SparkSession, d: str) -> DataFrame:
    return cursor.seek_first(mix_tables(spark, d))


@query("SELECT file_number, max(key) AS key, arg_max(val, key) AS val, arg_max(tombstone, key) AS tombstone FROM mix GROUP BY 1", "mix")
def seek_last(spark: SparkSession, d: str) -> DataFrame:
    return cursor.seek_last(mix_tables(spark, d))


@query("SELECT file_number, key, val, tombstone FROM mix WHERE key = 'k000000000000010'", "mix")
def seek_exact(spark: SparkSession, d: str) -> DataFrame:
    return cursor.seek(mix_tables(spark, d), "k000000000000010")


@query("SELECT file_number, key, lead(key) OVER (PARTITION BY file_number ORDER BY key) AS next_key FROM mix", "mix")
def cursor_next(spark: SparkSession, d: str) -> DataFrame:
    return cursor.following(mix_tables(spark, d))


_ENTRY = "'(' || key || ', ' || coalesce(val, '') || ', ' || CASE WHEN tombstone THEN 'true' ELSE 'false' END || ')'"


@query(f"SELECT file_number, 'SSTable[' || string_agg({_ENTRY}, ', ' ORDER BY key) || ']' AS text FROM mix GROUP BY 1", "mix")
def table_render(spark: SparkSession, d: str) -> DataFrame:
    return cursor.rendered(mix_tables(spark, d))


@query(f"SELECT seq, {_ENTRY} AS text FROM m_events", "m_events")
def entry_render(spark: SparkSession, d: str) -> DataFrame:
    return m_events(spark, d).select("seq", cursor.entry_text().alias("text"))


@query("SELECT level, key, e.val AS val, e.tombstone AS tombstone FROM (SELECT level, key, arg_max({'val': val, 'tombstone': tombstone}, file_number) AS e FROM tables GROUP BY 1, 2)", "m_orders", "tables")
def level_get(spark: SparkSession, d: str) -> DataFrame:
    last = F.max_by(F.struct("val", "tombstone"), "file_number").alias("e")
    return order_tables(spark, d).groupBy("level", "key").agg(last).select("level", "key", "e.*")


@query(f", {_FIRST} SELECT key, e.val AS val, e.tombstone AS tombstone, e.level AS level, e.file_number AS file_number FROM first", "m_orders", "tables")
def level_precedence(spark: SparkSession, d: str) -> DataFrame:
    return resolve.precedence(order_tables(spark, d))


@query("SELECT file_number, CAST(grp AS BIGINT) AS grp FROM groups", "mix", "groups")
def overlap_groups(spark: SparkSession, d: str) -> DataFrame:
    return compact.overlap_groups(flush.metadata(mix_tables(spark, d))).select("file_number", "grp")


_MERGED = "merged AS (SELECT grp, key, arg_max({'val': val, 'tombstone': tombstone, 'seq': mix.seq}, -mix.level * 1000000000 + mix.file_number) AS e FROM mix JOIN groups ON mix.file_number = groups.file_number GROUP BY 1, 2)"


@query(f", {_MERGED} SELECT CAST(grp AS BIGINT) AS grp, key, e.val AS val, e.tombstone AS tombstone, e.seq AS seq FROM merged", "mix", "groups")
def merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    return compact.merge_overlapping(mix_tables(spark, d))


@query(
    "SELECT p.file_number AS probe, m.file_number FROM manifest p JOIN manifest m ON m.min_key <= p.max_key AND m.max_key >= p.min_key WHERE p.level = 0 AND m.level = 1", "mix", "groups"
)
def overlapping_files_join(spark: SparkSession, d: str) -> DataFrame:
    manifest = flush.metadata(mix_tables(spark, d))
    probes = manifest.where("level = 0").select(F.col("file_number").alias("probe"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    return compact.overlapping(manifest.where("level = 1"), probes)


_INTO = f""", {_MERGED}, moving AS (SELECT grp FROM groups GROUP BY grp HAVING min(level) = 0),
after AS (SELECT key, e.val AS val, e.tombstone AS tombstone, e.seq AS seq, true AS moved FROM merged WHERE grp IN (SELECT grp FROM moving)
  UNION ALL SELECT mix.key, mix.val, mix.tombstone, mix.seq, false FROM mix JOIN groups ON mix.file_number = groups.file_number WHERE grp NOT IN (SELECT grp FROM moving))"""


def _moved(spark: SparkSession, d: str, **options) -> DataFrame:
    before = mix_tables(spark, d)
    after = compact.compact_into(before, 0, **options)
    moved = F.col("file_number") >= 2000000  # all tables of level 0 move; the others have lower numbers
    return after.select("key", "val", "tombstone", "seq", moved.alias("moved"))


@query(f"{_INTO} SELECT key, val, tombstone, seq, moved FROM after", "mix", "groups")
def compact_into_next(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d)


@query(f"{_INTO} SELECT key, val, tombstone, seq, moved FROM after WHERE NOT (moved AND tombstone)", "mix", "groups")
def compact_bottom_gc(spark: SparkSession, d: str) -> DataFrame:
    return _moved(spark, d, bottom=1, gc=True)


@query(f"{_INTO} SELECT key, val, tombstone, seq FROM after", "mix", "groups")
def compact_cascade(spark: SparkSession, d: str) -> DataFrame:
    return compact.cascade(mix_tables(spark, d), 2).select("key", "val", "tombstone", "seq")


@query(
    """, latest AS (SELECT key, arg_max(tombstone, -level * 1000000000 + file_number) AS dead FROM mix GROUP BY key),
n AS (SELECT count(*) AS n FROM latest WHERE NOT dead) SELECT n AS before, n AS after, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained FROM n""",
    "mix",
)
def compaction_invariance(spark: SparkSession, d: str) -> DataFrame:
    tables = mix_tables(spark, d)
    before = resolve.live(resolve.precedence(tables)).select("key", "val", F.lit(1).alias("b"), F.lit(0).alias("a"))
    after = resolve.live(resolve.precedence(compact.cascade(tables, 2))).select("key", "val", F.lit(0).alias("b"), F.lit(1).alias("a"))
    rows = before.unionByName(after).groupBy("key", "val").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return rows.agg(
        F.sum("b").alias("before"), F.sum("a").alias("after"), F.sum(F.when(F.col("a") == 0, F.col("b")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("b") == 0, F.col("a")).otherwise(0)).alias("gained")
    )


@query("SELECT file_number, level, ts_ms, min_key, max_key, n_entries FROM manifest ORDER BY ts_ms, file_number LIMIT 1", "mix", "groups")
def oldest_table(spark: SparkSession, d: str) -> DataFrame:
    return compact.oldest(flush.metadata(mix_tables(spark, d)))


@query(
    """, top AS (SELECT * FROM manifest WHERE level = 0 ORDER BY ts_ms, file_number LIMIT 1),
taken AS (SELECT file_number FROM top UNION ALL SELECT m.file_number FROM manifest m, top WHERE m.level = 1 AND m.min_key <= top.max_key AND m.max_key >= top.min_key),
one AS (SELECT key, arg_max({'val': val, 'tombstone': tombstone, 'seq': seq}, -level * 1000000000 + file_number) AS e FROM mix WHERE file_number IN (SELECT file_number FROM taken) GROUP BY key)
SELECT key, e.val AS val, e.tombstone AS tombstone, e.seq AS seq FROM one""",
    "mix",
    "groups",
)
def compact_oldest(spark: SparkSession, d: str) -> DataFrame:
    return compact.compact_oldest(mix_tables(spark, d), 0)


@query("SELECT file_number, level, ts_ms, min_key, max_key, n_entries FROM manifest WHERE file_number NOT IN (SELECT file_number FROM manifest WHERE level = 0)", "mix", "groups")
def drop_tables(spark: SparkSession, d: str) -> DataFrame:
    manifest = flush.metadata(mix_tables(spark, d))
    return compact.without_tables(manifest, manifest.where("level = 0")).select("file_number", "level", "ts_ms", "min_key", "max_key", "n_entries")


_BITS = """h AS (SELECT file_number, key, CAST('0x' || substr(md5(key || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % 1000 AS bit FROM mix, range(7) t(i)),
probe AS (SELECT key, CAST('0x' || substr(md5(key || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % 1000 AS bit FROM (SELECT DISTINCT key FROM mix), range(7) t(i)),
edges AS (SELECT file_number, min(key) AS min_key, max(key) AS max_key FROM mix GROUP BY 1),
needed AS (SELECT key, count(DISTINCT bit) AS n FROM probe GROUP BY key),
hits AS (SELECT p.key, f.file_number FROM (SELECT DISTINCT key, bit FROM probe) p JOIN edges ON p.key BETWEEN min_key AND max_key
  JOIN (SELECT DISTINCT file_number, bit FROM h) f ON p.bit = f.bit AND f.file_number = edges.file_number JOIN needed ON needed.key = p.key
  GROUP BY p.key, f.file_number HAVING count(*) = any_value(needed.n))"""


@query(f", {_BITS} SELECT DISTINCT file_number, bit FROM h", "mix")
def bloom_bits(spark: SparkSession, d: str) -> DataFrame:
    return bloom.bits(mix_tables(spark, d))


def _probed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = mix_tables(spark, d)
    return tables, bloom.may_contain(bloom.filters(tables), flush.metadata(tables), tables.select("key").distinct())


@query(f", {_BITS} SELECT key, file_number FROM hits", "mix")
def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    return _probed(spark, d)[1]


@query(
    f""", {_BITS} SELECT count(*) AS claimed, count(m.key) AS right, (SELECT count(*) FROM mix) - count(m.key) AS missed
FROM hits LEFT JOIN mix m ON hits.key = m.key AND hits.file_number = m.file_number""",
    "mix",
)
def bloom_fp_rate(spark: SparkSession, d: str) -> DataFrame:
    tables, claimed = _probed(spark, d)
    there = tables.select("key", "file_number", F.lit(1).alias("there"))
    rows = claimed.withColumn("said", F.lit(1)).join(there, ["key", "file_number"], "full")
    both = F.count(F.when(F.col("said").isNotNull() & F.col("there").isNotNull(), 1))
    return rows.agg(F.count("said").alias("claimed"), both.alias("right"), (F.count("there") - both).alias("missed"))


@query("SELECT coalesce(max(file_number) + 1, 0) AS next_file_number FROM mix", "mix")
def next_file_number(spark: SparkSession, d: str) -> DataFrame:
    return mix_tables(spark, d).agg(F.coalesce(F.max("file_number") + 1, F.lit(0)).alias("next_file_number"))


@query(
    "SELECT path, CAST(nullif(regexp_extract(path, '^.*/level-([0-9]+)/[^/]+$', 1), '') AS INT) AS level FROM (SELECT 'base/level-' || n_regionkey || CASE WHEN n_nationkey % 7 = 0 THEN 'x' ELSE '' END || '/table-' || n_nationkey AS path, n_regionkey FROM nation) WHERE regexp_matches(path, '^.*/level-[0-9]+/[^/]+$') AND n_regionkey <= 3"
)
def level_dirs(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("n_nationkey") % 7 == 0, "x").otherwise("")
    paths = read(spark, d, "nation").select(F.concat(F.lit("base/level-"), F.col("n_regionkey").cast("string"), odd, F.lit("/table-"), F.col("n_nationkey").cast("string")).alias("path"))
    level = F.regexp_extract("path", r"^.*/level-([0-9]+)/[^/]+$", 1)
    return paths.withColumn("level", F.when(level != "", level).cast("int")).where("level <= 3")


_BE = "printf('%08x', octet_length(encode({0}))) || lower(hex(encode({0})))"
_VAL = "CASE WHEN tombstone THEN '' ELSE coalesce(val, '') END"
_LE = "substr(printf('%08x', octet_length(encode({0}))), 7, 2) || substr(printf('%08x', octet_length(encode({0}))), 5, 2) || substr(printf('%08x', octet_length(encode({0}))), 3, 2) || substr(printf('%08x', octet_length(encode({0}))), 1, 2)"


@query(f"SELECT seq, {_BE.format('key')} || {_BE.format(_VAL)} || CASE WHEN tombstone THEN '01' ELSE '00' END AS hex FROM m_events", "m_events")
def sstable_encode_hex(spark: SparkSession, d: str) -> DataFrame:
    return m_events(spark, d).select("seq", F.lower(codec.entry_hex()).alias("hex"))


@query(
    f"SELECT seq, CASE WHEN tombstone THEN '01' ELSE '00' END || {_LE.format('key')} || {_LE.format(_VAL)} || lower(hex(encode(key))) || lower(hex(encode({_VAL}))) AS hex FROM m_events", "m_events"
)
def wal_encode_hex(spark: SparkSession, d: str) -> DataFrame:
    return m_events(spark, d).select("seq", F.lower(codec.record_hex()).alias("hex"))


@query("SELECT file_number, key, val, tombstone FROM tables", "m_orders", "tables")
def sstable_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return codec.read_tables(codec.encoded_tables(order_tables(spark, d))).select("file_number", "key", "val", "tombstone")


@query("SELECT tables.file_number, key, val, tombstone, m.ts AS ts FROM tables JOIN (SELECT file_number, max(seq) AS ts FROM tables GROUP BY 1) m ON tables.file_number = m.file_number", "m_orders", "tables")
def sstable_version_1_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Files of version 1 have no number in their trailer: it stands beside the content here, as in a file's name."""
    files = codec.encoded_tables(order_tables(spark, d), version=1)
    return codec.read_tables(files, version=1, number="file_number").select("file_number", "key", "val", "tombstone", "ts")


@query("SELECT key, val, tombstone, seq // 128 AS segment FROM m_events", "m_events")
def wal_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return codec.read_log(codec.encoded_log(m_events(spark, d), F.floor(F.col("seq") / SEGMENT))).select("key", "val", "tombstone", "segment")


@query(
    "SELECT key, val, tombstone, segment FROM (SELECT *, seq // 128 AS segment, row_number() OVER (PARTITION BY seq // 128 ORDER BY seq DESC) AS n FROM m_events) WHERE n > 1", "m_events"
)
def wal_partial_tail(spark: SparkSession, d: str) -> DataFrame:
    files = codec.encoded_log(m_events(spark, d), F.floor(F.col("seq") / SEGMENT))
    cut = files.withColumn("content", F.expr("substring(content, 1, octet_length(content) - 3)"))
    return codec.read_log(cut).select("key", "val", "tombstone", "segment")


@query(
    f""", latest AS (SELECT key, last.val AS val FROM {_LATEST} WHERE NOT last.tombstone),
lines AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'PuT u1' WHEN 1 THEN 'get u' || lpad(CAST(user_id AS VARCHAR), 6, '0') WHEN 2 THEN 'DEL' WHEN 3 THEN 'put a 1 extra'
  WHEN 4 THEN 'scan' ELSE 'Del u' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS line, event_id % 6 AS k, 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key FROM events)
SELECT line, CASE WHEN k = 3 THEN true WHEN k IN (1, 5) THEN latest.key IS NOT NULL ELSE false END AS success,
  CASE k WHEN 0 THEN 'Usage: PUT <key> <value>' WHEN 2 THEN 'Usage: DEL <key>' WHEN 3 THEN 'OK' WHEN 4 THEN 'Unknown command'
    WHEN 1 THEN CASE WHEN latest.key IS NOT NULL THEN '' ELSE 'Key does not exist' END
    ELSE CASE WHEN latest.key IS NOT NULL THEN 'OK' ELSE 'Failed to DELETE key: Cannot DELETE: key does not exist' END END AS message,
  CASE WHEN k = 1 THEN latest.val END AS data FROM lines LEFT JOIN latest ON lines.key = latest.key AND k IN (1, 5)""",
    "m_events",
)
def command_dispatch(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    k = F.col("event_id") % 6
    line = F.when(k == 0, "PuT u1").when(k == 1, F.concat(F.lit("get "), key)).when(k == 2, "DEL").when(k == 3, "put a 1 extra").when(k == 4, "scan").otherwise(F.concat(F.lit("Del "), key))
    return commands.dispatch(read(spark, d, "events").select(line.alias("line")), resolve.latest_by_agg(m_events(spark, d)))


_LOAD = """n AS (SELECT count(*) AS n FROM part), r AS (SELECT i FROM n, range(CAST(n.n AS BIGINT)) t(i)),
v AS (SELECT i, chr(97 + CAST(i & 15 AS INT)) || chr(97 + CAST((i >> 3) & 15 AS INT)) || chr(97 + CAST((i >> 6) & 15 AS INT)) || chr(97 + CAST((i >> 9) & 15 AS INT)) || chr(97 + CAST((i >> 12) & 15 AS INT))
  || chr(97 + CAST((i >> 15) & 15 AS INT)) || chr(97 + CAST((i >> 18) & 15 AS INT)) || chr(97 + CAST((i >> 21) & 15 AS INT)) || repeat('x', 56) AS val FROM (SELECT i FROM r UNION SELECT i + 1 FROM r)),
log AS (SELECT 'k' || lpad(CAST(r.i AS VARCHAR), 15, '0') AS key, val, false AS tombstone, r.i AS seq FROM r JOIN v ON r.i = v.i
  UNION ALL SELECT 'k' || lpad(CAST(r.i AS VARCHAR), 15, '0'), val, false, n.n + r.i FROM n, r JOIN v ON r.i + 1 = v.i WHERE r.i % 10 = 0
  UNION ALL SELECT 'k' || lpad(CAST(r.i AS VARCHAR), 15, '0'), NULL, true, 2 * n.n + r.i FROM n, r WHERE r.i % 10 = 5)"""


def _load(spark: SparkSession, d: str) -> DataFrame:
    return workload.load(spark, read(spark, d, "part").count())


@query(f"WITH {_LOAD} SELECT 'k' || lpad(CAST(i AS VARCHAR), 15, '0') AS key FROM r")
def workload_keys(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(read(spark, d, "part").count()).select(workload.padded_key(F.col("id")).alias("key"))


@query(f"WITH {_LOAD} SELECT key, val, tombstone, CAST(seq AS BIGINT) AS seq FROM log")
def workload_mix(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d)


@query(f"WITH {_LOAD} SELECT key, e.val AS val FROM (SELECT key, arg_max({{'val': val, 'dead': tombstone}}, seq) AS e FROM log GROUP BY key) WHERE NOT e.dead")
def workload_latest(spark: SparkSession, d: str) -> DataFrame:
    return resolve.live(resolve.latest_by_agg(_load(spark, d))).select("key", "val")


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT 'key-' || i AS key FROM n, range(CAST(n.n AS BIGINT)) t(i)")
def workload_shuffled_keys(spark: SparkSession, d: str) -> DataFrame:
    return workload.shuffled_keys(spark, read(spark, d, "part").count())


@query(f"WITH {_LOAD} SELECT count(*) AS ops, CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(val)), 0)) AS BIGINT) AS bytes FROM log")
def throughput_bytes(spark: SparkSession, d: str) -> DataFrame:
    return workload.payload(_load(spark, d))


@query(f", live AS (SELECT count(*) AS n FROM {_LATEST} WHERE NOT last.tombstone) SELECT (SELECT count(*) FROM m_events) AS written, n AS live FROM live", "m_events")
def space_amplification(spark: SparkSession, d: str) -> DataFrame:
    log = m_events(spark, d)
    newest = F.max_by("tombstone", "seq").alias("dead")
    return log.groupBy("key").agg(newest, F.count("*").alias("n")).agg(F.sum("n").alias("written"), F.count(F.when(~F.col("dead"), 1)).alias("live"))


@query(
    """, e AS (SELECT *, row_number() OVER (ORDER BY seq) AS rn, coalesce(lag(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS before FROM m_events),
starts AS (SELECT 0 AS file_number, min(seq) AS first FROM e
  UNION ALL SELECT any_value(s.file_number) + 1, list_sort(list(e.seq))[128] + 1 FROM starts s JOIN e ON e.seq >= s.first AND e.before < s.first HAVING count(*) >= 128)
SELECT key, val, tombstone, seq, CAST(file_number AS BIGINT) AS file_number FROM e ASOF JOIN starts ON e.seq >= starts.first""",
    "m_events",
    recursive=True,
)
def exact_memtable_segments(spark: SparkSession, d: str) -> DataFrame:
    return flush.exact_segments(m_events(spark, d), SEGMENT)
