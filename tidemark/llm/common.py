"""What several operators share: the checkpoint folder, written stages, Arrow columns and a document fold."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = 5


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir or what setCheckpointDir named. Where neither is
    set, a local session (one machine) gets a new folder; a cluster's own folders are not shared, so there it is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        named = context.getCheckpointDir()
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, readable after executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out from learning. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def with_field(df: DataFrame, *fields: tuple[str, str], drop: tuple[str, ...] = ()) -> T.StructType:
    """Schema of df with fields replaced or appended, as a mapInArrow result."""
    new = T.StructType()
    names = {n for n, _ in fields} | set(drop)
    for f in df.schema.fields:
        if f.name not in names:
            new = new.add(f)
    for n, kind in fields:
        new = new.add(n, T.DataType.fromDDL(kind))
    return new


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """batch with columns replaced or appended, in the order of with_field."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in new and n not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(i) for i in keep] + list(new.values()), names=[batch.schema.names[i] for i in keep] + list(new)
    )


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x or "" for x in column.to_pylist()]


def slices(lengths: np.ndarray, most: int):
    """Ranges of rows whose lengths sum to about `most` or that are one row: bounds what a task holds at a time."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, len(lengths)


#: Rows of an Arrow batch: whole texts are long, and the JVM and Python each hold a batch on its way in and out.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release() -> None:
    """Gives a worker's freed memory back at the end of a task: Spark keeps workers for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
