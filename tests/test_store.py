"""Behaviour of the store: reads never depend on where flushes and compactions fall."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bloom, compact, cursor, flush, mutations, resolve
from tidemark.schema import EngineConfig, MANIFEST, TABLE
from tidemark.sources import codec
from tidemark.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, EngineConfig(str(tmp_path / "db")))


def test_put_and_get(store):
    assert store.put("hello", "world")["success"]
    assert store.get("hello") == {"success": True, "message": "", "data": "world"}


def test_flush_writes_tables(store):
    for k, v in zip("abc", "123"):
        store.put(k, v)
    assert store.flush()["success"]
    assert [store.get(k)["data"] for k in "abc"] == ["1", "2", "3"]
    assert not store.memtable


def test_newest_table_wins_and_deletes_hide(store):
    store.put("key", "old")
    store.put("ghost", "value")
    store.flush()
    store.put("key", "new")
    store.delete("ghost")
    store.flush()
    assert store.get("key")["data"] == "new"
    assert store.get("ghost") == {"success": False, "message": "Key does not exist", "data": None}
    store.compact()
    assert store.get("key")["data"] == "new"
    assert not store.get("ghost")["success"]


def test_compaction_preserves_entries_and_reopens(spark, store):
    for k, v in (("b", "1"), ("a", "2"), ("c", "3")):
        store.put(k, v)
    store.flush()
    for k, v in (("f", "4"), ("e", "5"), ("g", "6")):
        store.put(k, v)
    store.compact()
    assert [store.get(k)["data"] for k in "bce"] == ["1", "3", "5"]
    assert {t["level"] for t in store.manifest} == {3}
    store.put("z", "9")
    again = Store(spark, store.config)
    assert again.get("z")["data"] == "9" and again.get("b")["data"] == "1"
    assert [r["key"] for r in again.scan().collect()] == ["a", "b", "c", "e", "f", "g", "z"]
    again.vacuum()
    assert again.get("e")["data"] == "5"


def test_tombstone_across_levels(store):
    store.put("k", "1")
    store.compact()
    store.delete("k")
    store.flush()
    assert not store.get("k")["success"]


def test_deletes_of_dead_keys_are_rejected(store):
    message = "Failed to DELETE key: Cannot DELETE: key does not exist"
    assert store.delete("nope") == {"success": False, "message": message, "data": None}
    store.put("a", "1")
    assert store.delete("a")["success"]
    assert store.delete("a")["message"] == message


def test_empty_flush_and_capacity(store):
    assert store.flush()["success"] and not store.manifest
    for k in "abc":
        store.put(k, "1")
    assert not store.manifest
    store.put("a", "2")
    assert len(store.manifest) == 1 and set(store.memtable) == {"a"}


def test_commands(store):
    assert store.execute("PuT", ["a"])["message"] == "Usage: PUT <key> <value>"
    assert store.execute("get", [])["message"] == "Usage: GET <key>"
    assert store.execute("DEL", [])["message"] == "Usage: DEL <key>"
    assert store.execute("put", ["a", "1", "extra"])["message"] == "OK"
    assert store.execute("get", ["a"]) == {"success": True, "message": "", "data": "1"}
    assert store.execute("scan", [])["message"] == "Unknown command"


def test_against_a_dict(store):
    draw, model = random.Random(4), {}
    for step in range(30):
        key, act = draw.choice("abcde"), draw.random()
        if act < 0.5:
            store.put(key, str(step))
            model[key] = str(step)
        elif act < 0.8:
            assert store.delete(key)["success"] == (key in model)
            model.pop(key, None)
        elif act < 0.9:
            store.flush()
        else:
            store.compact()
    assert {r["key"]: r["val"] for r in store.scan().collect()} == model


def _manifest(spark, ranges):
    return spark.createDataFrame([(k, 0, k, a, b, 1) for k, (a, b) in enumerate(ranges, 1)], MANIFEST)


def test_overlap_groups(spark):
    groups = lambda ranges: [r["grp"] for r in compact.overlap_groups(_manifest(spark, ranges)).orderBy("file_number").collect()]
    assert groups([("a", "c"), ("e", "g"), ("f", "h")]) == [1, 2, 2]
    assert groups([("a", "c"), ("c", "e")]) == [1, 1]
    assert groups([("a", "b"), ("d", "e"), ("g", "h"), ("j", "k")]) == [1, 2, 3, 4]


def test_disjoint_groups_all_move(spark):
    rows = [(k, k, False, n, 0, n) for n, pair in enumerate(("ab", "de", "gh", "jk")) for k in pair]
    after = compact.cascade(spark.createDataFrame(rows, TABLE), 2)
    assert {r["level"] for r in after.select("level").distinct().collect()} == {2}
    assert after.count() == 8


def test_byte_order_and_rendering(spark):
    rows = spark.createDataFrame([(k, "v", False, 0, 0, 0) for k in ("z", "é", "a", "ab")], TABLE)
    assert [r["key"] for r in cursor.scan(rows).collect()] == ["a", "ab", "z", "é"]
    assert cursor.rendered(rows).first()["text"] == "SSTable[(a, v, false), (ab, v, false), (z, v, false), (é, v, false)]"


def test_exact_segments(spark):
    log = spark.createDataFrame([(k, "1", False, n) for n, k in enumerate("abcadd")], "key string, val string, tombstone boolean, seq bigint")
    assert [r["file_number"] for r in flush.exact_segments(log, 3).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize(("capacity", "names"), [(1, 2), (3, 4), (5, 6), (5, 200), (7, 7), (9, 12), (9, 5), (40, 60)])
def test_exact_segments_over_stretches(spark, monkeypatch, capacity, names):
    """Borders run on over the stretches of a log, hot keys and null keys too, and no task has the whole log."""
    monkeypatch.setattr(flush, "STRETCH", 25, raising=False)
    monkeypatch.setattr(flush, "PER_KEY", 1, raising=False)
    rng = random.Random(capacity * 1000 + names)
    keys = [rng.choice([None, "k0", "k1", "k2"]) if n // 90 % 2 else f"k{rng.randrange(names)}" for n in range(500)]
    want, number, seen = [], 0, set()
    for key in keys:
        if len(seen) == capacity:
            number, seen = number + 1, set()
        seen.add(key)
        want.append(number)
    rows = [(k, "1", False, 7 * n - 900) for n, k in enumerate(keys)]
    rng.shuffle(rows)
    got = flush.exact_segments(spark.createDataFrame(rows, "key string, val string, tombstone boolean, seq bigint"), capacity)
    assert [r["file_number"] for r in got.orderBy("seq").collect()] == want
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 5 and max(r["count"] for r in tasks) < 200


def test_bloom_never_misses(spark):
    rows = spark.createDataFrame([(f"k{n}", "v", False, n % 5, 0, n) for n in range(200)], TABLE)
    claimed = bloom.may_contain(bloom.filters(rows), flush.metadata(rows), rows.select("key").distinct())
    assert rows.join(claimed, ["key", "file_number"], "left_anti").count() == 0
    bitmap = {r["file_number"]: r["filter"] for r in bloom.filters(rows).collect()}
    assert all(bloom.has(bitmap[n % 5], f"k{n}") for n in range(200))
    said = {(r["key"], r["file_number"]) for r in claimed.collect()}
    low = {r["file_number"]: (r["min_key"], r["max_key"]) for r in flush.metadata(rows).collect()}
    assert said == {(f"k{n}", t) for n in range(200) for t in range(5) if low[t][0] <= f"k{n}" <= low[t][1] and bloom.has(bitmap[t], f"k{n}")}
    bit_rows = {t: {r["bit"] for r in bloom.bits(rows).where(F.col("file_number") == t).collect()} for t in range(5)}
    assert all({b for b in range(1000) if bitmap[t][b // 64] >> (b % 64) & 1} == bit_rows[t] for t in range(5))


def test_bloom_compares_only_near_tables(spark, monkeypatch):
    """Nested, touching, single and empty ranges, keys outside and repeated, many small stretches: as by brute force, and no
    key is compared with all tables."""
    monkeypatch.setattr(bloom, "STRETCH", 4, raising=False)
    monkeypatch.setattr(bloom, "RANGE", 50, raising=False)
    rng = random.Random(5)
    spots = [(t, n) for t in range(60) for n in range(t * 8, t * 8 + 8)] + [(60, n) for n in range(0, 480, 40)] + [(61, 7), (62, 100), (62, 300)]
    spots += [(63 + t, n) for t in range(20) for n in rng.sample(range(100, 140), 3)]
    rows = spark.createDataFrame([(f"k{n:04d}", "v", False, t, 0, i) for i, (t, n) in enumerate(spots)], TABLE)
    asked = [f"k{n:04d}" for n in range(0, 600, 3)] + ["", "a", "k0120", "k0120", "z", "é", None]
    bitmap = {r["file_number"]: r["filter"] for r in bloom.filters(rows).collect()}
    low = {r["file_number"]: (r["min_key"], r["max_key"]) for r in flush.metadata(rows).collect()}
    claimed = bloom.may_contain(bloom.filters(rows), flush.metadata(rows), spark.createDataFrame([(k,) for k in asked], "key string"))
    want = sorted((k, t) for k in asked if k is not None for t in low if low[t][0] <= k <= low[t][1] and bloom.has(bitmap[t], k))
    assert sorted((r["key"], r["file_number"]) for r in claimed.collect()) == want
    plan = claimed._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_batches_of_many_tables(spark, tmp_path):
    """A batch becomes several tables; compaction keeps entries, the newest overwrite and deletes, and writes each table once."""
    store = Store(spark, EngineConfig(str(tmp_path / "db"), table_entries=100, gc_tombstones=True))
    frame = lambda rows: spark.createDataFrame(rows, "key string, val string, tombstone boolean, seq bigint")
    store.write_batch(frame([(f"k{n:04d}", "old", False, n) for n in range(500)]))
    assert len(store.manifest) == 5 and all(t["ts_ms"] > 1_600_000_000_000 for t in store.manifest)
    edges = sorted((t["min_key"], t["max_key"]) for t in store.manifest)
    assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    store.write_batch(frame([(f"k{n:04d}", "new", False, n) for n in range(0, 500, 5)] + [(f"k{n:04d}", None, True, 600 + n) for n in range(1, 500, 5)]))
    want = {f"k{n:04d}": "new" if n % 5 == 0 else "old" for n in range(500) if n % 5 != 1}
    assert {r["key"]: r["val"] for r in store.scan().collect()} == want
    assert store.get("k0003")["data"] == "old" and not store.get("k0001")["success"] and not store.get("k0003x")["success"]
    store.compact()
    assert {r["key"]: r["val"] for r in store.scan().collect()} == want
    assert {t["level"] for t in store.manifest} == {3} and sum(t["n_entries"] for t in store.manifest) == len(want)
    for level in {t["level"] for t in store.manifest}:
        edges = sorted((t["min_key"], t["max_key"]) for t in store.manifest if t["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    assert {r["key"]: r["val"] for r in Store(spark, store.config).scan().collect()} == want


def test_steps_and_cascade_agree(spark):
    """One merge after all steps are planned gives what merging after each step gives, and reads entries as often at any number of levels."""
    draw = random.Random(21)
    rows, number = [], 0
    for level, many in ((2, 6), (1, 5), (0, 7)):
        for k in range(many):
            span = range(k * 20, k * 20 + 19) if level else draw.sample(range(150), 9)
            rows += [(f"k{n:03d}", None if n % 7 == level else f"{level}-{n}", n % 7 == level, number, level, number * 1000 + n) for n in span if draw.random() < 0.8]
            number += 1
    tables = spark.createDataFrame(rows, TABLE)
    for gc in (False, True):
        steps = tables
        for level in range(3):
            steps = compact.compact_into(steps, level, 3, gc).cache()
        got = compact.cascade(tables, 3, gc)
        columns = ["key", "val", "tombstone", "file_number", "level", "seq"]
        assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, steps.select(columns).collect()))
    plan = compact.cascade(tables, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4, "entries and the manifest, for tables that stay and that move"


def test_files_written_and_measured(spark, tmp_path):
    from tidemark.functions.workload import directory_size

    rows = spark.createDataFrame([(k, "v", False, n % 2, 0, n) for n, k in enumerate("abcdef")], TABLE)
    said = codec.write_tables(rows, str(tmp_path / "tables")).collect()
    back = codec.open_tables(spark, str(tmp_path / "tables" / "table-*"))
    assert {(r["key"], r["file_number"]) for r in back.collect()} == {(k, n % 2) for n, k in enumerate("abcdef")}
    assert directory_size(spark, str(tmp_path / "tables")).first()["bytes"] == sum(r["bytes"] for r in said) > 0
    codec.write_log(rows.select("key", "val", "tombstone", "seq"), F.floor(F.col("seq") / 4), str(tmp_path / "log")).collect()
    assert [(r["key"], r["segment"]) for r in codec.open_log(spark, str(tmp_path / "log" / "wal-*")).orderBy("segment", "place").collect()] == [(k, n // 4) for n, k in enumerate("abcdef")]


def test_codec_bytes_and_damage(spark):
    one = spark.createDataFrame([("a", "1", False, 2, 0, 1)], TABLE)
    assert codec.encoded_tables(one).first()["content"].hex() == "0000000161000000013100" + "0100000000000000" + "0200000000000000"
    log = one.select("key", "val", "tombstone", "seq")
    assert bytes(codec.encoded_log(log, F.lit(0)).first()["content"]).hex() == "0001000000010000006131"
    dead = mutations.deletes(log)
    assert bytes(codec.encoded_log(dead, F.lit(0)).first()["content"]).hex() == "01010000000000000061"
    data = bytes.fromhex("0001000000010000006131")
    assert codec.decode_records(data + data[:7]) == [("a", "1", False)]
    with pytest.raises(ValueError):
        codec.decode_records(b"\x00" + b"\xff" * 8 + b"a")
    with pytest.raises(ValueError):
        codec.decode_entries(b"\x00\x00\x00\x09a" + b"\x00" * 16)


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "wal-7").write_bytes(bytes.fromhex("0001000000010000006131" + "01010000000000000061") + b"\x00\x01")
    assert [tuple(r) for r in codec.open_log(spark, str(tmp_path / "wal-*")).orderBy("place").collect()] == [("a", "1", False, 7, 0), ("a", None, True, 7, 1)]
    one = spark.createDataFrame([("a", "1", False, 2, 0, 1), ("b", None, True, 2, 0, 5)], TABLE)
    for version in (1, 2):
        (tmp_path / f"table-{version}").write_bytes(codec.encoded_tables(one, version).first()["content"])
        rows = codec.open_tables(spark, str(tmp_path / f"table-{version}"), version).orderBy("key").collect()
        assert [(r["key"], r["val"], r["tombstone"], r["ts"]) for r in rows] == [("a", "1", False, 5), ("b", None, True, 5)]


def test_multi_get(spark):
    rows = spark.createDataFrame([("a", "1", False, 0, 1, 0), ("b", "2", False, 0, 1, 1), ("b", None, True, 1, 0, 2)], TABLE)
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r["key"]: (r["success"], r["message"], r["data"]) for r in resolve.multi_get(keys, rows).collect()}
    assert got == {"a": (True, "", "1"), "b": (False, "Key does not exist", None), "c": (False, "Key does not exist", None)}


def test_stream_matches_batch(spark, tmp_path):
    from tidemark.schema import MUTATION
    from tidemark.streaming.ingest import append_batches, latest_stream

    rows = [("a", "1", False, 1), ("b", "2", False, 5), ("a", None, True, 3), ("b", "0", False, 2)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], MUTATION).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(MUTATION).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = latest_stream(stream).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("latest").collect()} == {("a", None, True, 3), ("b", "2", False, 5)}
    append_batches(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert {tuple(r) for r in resolve.latest_by_agg(stored).collect()} == {("a", None, True, 3), ("b", "2", False, 5)}
