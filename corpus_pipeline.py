"""The corpus pipeline: quality, near copies, repeated passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again. All but the last return the columns of documents. No stage
minds repeated rows, nulls, empty texts or extra columns (these are left out); an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_repeats, mixing, near_copies, piece_codec, quality
from tidemark.llm.common import short_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; the classifier learns from the labelled rows outside fold 0."""
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    features = written(quality.statistics(docs.select("doc_id", "text"), drop=("text",)), "statistics")
    model = quality.fit(features, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_texts(docs, model).where(quality.keep(F.col("score"))).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    short_batches(spark)
    docs = docs.select(*COLUMNS)
    dropped = near_copies.near_copies(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that start earlier too; parts of characters at the cuts go with them."""
    short_batches(spark)
    cut = byte_repeats.cut_repeats(docs.select(*COLUMNS), carry=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each pass over a document and one for its single blocks."""
    short_batches(spark)
    sized = docs.select(*COLUMNS, mixing.size_of(F.col("text")).alias("size"))
    return mixing.take(mixing.mix(sized), list(COLUMNS))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with an end id."""
    short_batches(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_codec.encode(docs.select(*COLUMNS), model, eos=True, drop=("text",))
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_one_of_each),
    ("byte_repeats", cut_repeats),
    ("mixing", mix_sources),
    ("piece_codec", to_ids),
]

#: Near copies, suffix sorting and merge tables have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
