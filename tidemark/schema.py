"""Schemas of the store: mutations, entries, tables, manifest rows, responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ENTRY = T.StructType().add("key", T.StringType(), False).add("val", T.StringType()).add("tombstone", T.BooleanType(), False)
MUTATION = T.StructType(list(ENTRY.fields)).add("seq", T.LongType(), False)
TABLE = T.StructType(list(ENTRY.fields)).add("file_number", T.LongType(), False).add("level", T.IntegerType(), False).add("seq", T.LongType(), False)
MANIFEST = (
    T.StructType()
    .add("file_number", T.LongType(), False)
    .add("level", T.IntegerType(), False)
    .add("ts_ms", T.LongType(), False)
    .add("min_key", T.StringType(), False)
    .add("max_key", T.StringType(), False)
    .add("n_entries", T.LongType(), False)
)
RESPONSE = T.StructType().add("success", T.BooleanType(), False).add("message", T.StringType(), False).add("data", T.StringType())


@dataclass(frozen=True)
class EngineConfig:
    """memtable_capacity counts distinct keys; levels run from 0 to max_levels; a batch becomes tables of about table_entries."""

    base: str
    memtable_capacity: int = 3
    max_levels: int = 3
    gc_tombstones: bool = False
    table_entries: int = 1_000_000
