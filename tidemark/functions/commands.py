"""Text commands as rows: parsing, checks and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import MISS

#: Fixed texts of the command interface.
USAGE = {"put": "Usage: PUT <key> <value>", "get": "Usage: GET <key>", "del": "Usage: DEL <key>"}
ARGUMENTS = {"put": 2, "get": 1, "del": 1}
UNKNOWN, OK = "Unknown command", "OK"
NOT_DELETED = "Failed to DELETE key: Cannot DELETE: key does not exist"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with verb (lower case) and args (words after it; what a verb does not need is ignored)."""
    words = F.split(F.trim(F.col(line)), r"\s+")
    return lines.withColumn("verb", F.lower(words[0])).withColumn("args", F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))


def problem() -> Column:
    """The message of a command that can't run; null if it can."""
    out = F.lit(UNKNOWN)
    for verb, usage in USAGE.items():
        own = F.when(F.size("args") < ARGUMENTS[verb], F.lit(usage))
        out = F.when(F.col("verb") == verb, own).otherwise(out)
    return out


def dispatch(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """(line, success, message, data) of each command on its own against resolved entries (key, val, tombstone)."""
    rows = parsed(lines).withColumn("problem", problem()).withColumn("key", F.when(F.col("problem").isNull(), F.col("args")[0]))
    alive = entries.where(~F.col("tombstone")).select("key", F.col("val"), F.lit(True).alias("hit"))
    rows = rows.join(alive, "key", "left")
    good, hit, verb = F.col("problem").isNull(), F.col("hit").isNotNull(), F.col("verb")
    return rows.select(
        "line",
        (good & ((verb == "put") | hit)).alias("success"),
        F.when(~good, F.col("problem")).when(verb == "put", OK).when((verb == "del") & hit, OK).when(verb == "del", NOT_DELETED).when(hit, "").otherwise(MISS).alias("message"),
        F.when(good & (verb == "get"), F.col("val")).alias("data"),
    )
