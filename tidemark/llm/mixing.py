"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources get blocks of equal size by the highest quotients target / (2 k + 1); each source's blocks go to its shards the
same way, so that every shard has an integer quota. A shard's words, its documents in a seeded order, are cut into blocks;
the quota is whole passes over them and a seeded choice of single blocks. A shard is a part of a source by hash, so a hot
source has more shards. The plans by source and by shard are written once; documents are read for their sizes and once more
to be dealt to their shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, slices, texts, with_field, written

WEIGHTS = (5, 2, 1)
#: The mix is so many times the corpus; no source is taken more than CAP times.
SHARE, CAP = 1.5, 2
#: Words of a shard, about; words of a block, whatever the size of the corpus.
SHARD_WORDS, LEAST_BLOCK = 1 << 20, 16
#: A prime above any shard's number of blocks: a step that visits all of them.
STEP = 2147483647
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of mix beside those of a document.
PLAN = ("size", "source_size", "target", "block", "place", "steps", "passes", "chosen", "shift", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, total) from (source, size): weights 5, 2, 1 by code point, null last; what a source
    can't take is shared again by weight. One row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("total", F.sum("source_size").over(everything))
    filling = Window.orderBy((CAP * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last())
    full = F.sum(CAP * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (SHARE * F.col("total") - F.coalesce(full, F.lit(0))) / rest
    rows = rows.withColumn("level", level)
    fits = F.col("level") * F.col("weight") < CAP * F.col("source_size")
    water = F.max(F.when(fits, F.col("level"))).over(everything)  # of the first source that stays below its cap, in order of filling
    return rows.withColumn("water", water).select(
        "source",
        "source_size",
        F.coalesce(F.least(CAP * F.col("source_size").cast("double"), F.col("water") * F.col("weight")), CAP * F.col("source_size").cast("double")).alias("target"),
        "total",
    )


def apportion(units: DataFrame, group: list[str], keys: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """units with `out`: their seats by the highest quotients votes / (2 k + 1); `seats` is the same in a group.

    Rounding votes times seats by the group's votes gives nearly all seats; the few seats over or short go to the highest
    next quotients, or leave the lowest last ones. Ties by keys. Groups without votes have no seats.
    """
    own = Window.partitionBy(*group)
    rows = units.withColumn("_v", F.sum(votes).over(own))
    fair = F.when(F.col("_v") > 0, F.col(votes) * F.col(seats) / F.col("_v")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_q", F.floor(fair + 0.5)).withColumn("_d", F.when(F.col("_v") > 0, F.col(seats) - F.sum("_q").over(own)).otherwise(0))
    most = F.ceil(F.abs("_d") * (F.col("_q") + 1) / F.greatest(F.col(seats), F.lit(1))) + 2  # of the seats that one unit can win or lose
    steps = rows.where("_d != 0").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long"))))
    quotient = F.when(F.col("_d") > 0, -F.col(votes) / (2 * (F.col("_q") + F.col("_j")) + 1)).otherwise(F.col(votes) / (2 * (F.col("_q") - F.col("_j")) - 1))
    steps = steps.where("_d > 0 OR _q > _j").withColumn("_n", F.row_number().over(own.orderBy(quotient, *[F.col(k).asc_nulls_last() for k in keys])))
    won = steps.where("_n <= abs(_d)").groupBy(*keys).agg(F.sum(F.signum("_d")).cast("long").alias("_w"))
    won = won.select(*[F.col(k).alias(f"_{k}") for k in keys], "_w")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(won, condition, "left").withColumn(out, (F.col("_q") + F.coalesce("_w", F.lit(0))).cast("long")).drop("_v", "_q", "_d", "_w", *[f"_{k}" for k in keys])


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """docs (doc_id, source, size and any other columns) with source_size, target, taken and what it is made of: passes
    over the whole document, and block, steps, shift, chosen, place from which `covers` tells the single blocks.

    Every row gets a result: sizes of 0 take nothing, a null source is a source of its own, repeated rows count apart and
    equal ids are ordered by size. Reruns agree. Null sizes count as 0. No document is taken more than twice its size.
    Columns of docs that are called like a result (PLAN) are replaced, whatever their letter case; all others stay.
    """
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    others = [c for c in docs.columns if c.lower() not in PLAN]
    own = F.struct(*[F.col(f"`{c}`") for c in others])  # apart from the plan's columns, whatever they are called
    rows = docs.select(
        own.alias("row"), "doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), hashed.alias("hash"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("name")
    )
    sizes = written(rows.select("source", "name", "size", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long").alias("part")), "mix-sizes")
    targets = source_targets(sizes)
    targets = targets.withColumn("block", F.lit(LEAST_BLOCK).cast("long")).withColumn("shards", F.ceil((F.col("source_size") + 1) / SHARD_WORDS).cast("long"))
    targets = targets.withColumn("one", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long"))
    targets = apportion(targets, ["one"], ["source"], "target", "seats", "source_blocks")
    plan = written(targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("name"), "source_size", "target", "block", "shards", "source_blocks"), "mix-sources")
    shards = sizes.join(plan, "name").groupBy("name", (F.col("part") % F.col("shards")).alias("shard")).agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = written(apportion(shards, ["name"], ["name", "shard"], "shard_size", "source_blocks", "quota").select("name", "shard", "shard_size", "quota"), "mix-shards")
    rows = rows.join(plan, "name").withColumn("shard", F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % F.col("shards")).join(shards, ["name", "shard"])
    order = Window.partitionBy("name", "shard").orderBy(F.substring("hash", 9, 24), F.col("doc_id"), F.col("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.sum("size").over(order) - F.col("size"))
    rows = rows.withColumn("steps", F.greatest(F.ceil(F.col("shard_size") / F.col("block")), F.lit(1)).cast("long"))
    quota = F.least(F.col("quota"), CAP * F.col("steps"))
    rows = rows.withColumn("passes", F.floor(quota / F.col("steps"))).withColumn("chosen", quota % F.col("steps"))
    rows = rows.withColumn("shift", F.length(F.coalesce("source", F.lit(""))) + 7 * F.col("shard"))
    blocks = F.sequence(F.floor(F.col("place") / F.col("block")), F.floor((F.col("place") + F.col("size") - 1) / F.col("block")))
    overlap = lambda j: F.least(F.col("place") + F.col("size"), (j + 1) * F.col("block")) - F.greatest(F.col("place"), j * F.col("block"))
    single = F.aggregate(blocks, F.lit(0).cast("long"), lambda n, j: n + F.when(_picked(j), overlap(j)).otherwise(0))
    rows = rows.withColumn("taken", F.when(F.col("size") > 0, F.col("passes") * F.col("size") + single).otherwise(0).cast("long"))
    return rows.select("row.*", *PLAN)


def _picked(j: Column) -> Column:
    return (j * (F.lit(STEP) % F.col("steps")) + F.col("shift")) % F.col("steps") < F.col("chosen")


def take(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of the mix: `columns` of `mixed`, a whole document once for each pass and its words in chosen blocks as one
    row more; n_chars, where it is among them, follows the text. Documents of which nothing is taken have no row."""
    names = [*columns, *(c for c in PLAN if c not in columns)]
    at = {c: k for k, c in enumerate(names)}
    word = re.compile(r"[^ \t-\r]+")

    def run(batches):
        for batch in batches:
            many = texts(batch.column(at["text"]))
            for a, b in slices(np.fromiter(map(len, many), np.int64, len(many)), 4_000_000):
                part = batch.slice(a, b - a)
                plan = {c: part.column(at[c]).to_pylist() for c in PLAN}
                rows, out = [], []
                for k, text in enumerate(many[a:b]):
                    for _ in range(plan["passes"][k] if plan["size"][k] else 0):
                        rows.append(k)
                        out.append(text)
                    if plan["taken"][k] > plan["passes"][k] * plan["size"][k]:
                        rows.append(k)
                        out.append(_chosen_words(text, word, plan, k))
                new = part.take(pa.array(rows, pa.int64())).select(columns)
                fields = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())}
                yield pa.RecordBatch.from_arrays([fields.get(c, new.column(k)) for k, c in enumerate(columns)], names=columns)
        release()

    schema = with_field(mixed.select(*columns))
    return mixed.where("taken > 0").select(*names).mapInArrow(run, schema)


def _chosen_words(text: str, word: re.Pattern, plan: dict, k: int) -> str:
    """The stretches of text whose words lie in chosen blocks, each as it stands, with a line end between them."""
    size, block, place, steps, chosen, shift = (plan[c][k] for c in ("size", "block", "place", "steps", "chosen", "shift"))
    picked = [j for j in range(place // block, (place + size - 1) // block + 1) if (j * (STEP % steps) + shift) % steps < chosen]
    ends = [m.span() for m in word.finditer(text)]
    runs: list[list[int]] = []
    for j in picked:
        first, last = max(0, j * block - place), min(size, (j + 1) * block - place)
        if runs and runs[-1][1] == first:
            runs[-1][1] = last
        else:
            runs.append([first, last])
    return "\n".join(text[ends[x][0] : ends[y - 1][1]] for x, y in runs)
