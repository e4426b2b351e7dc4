"""From a log to tables: segments, the newest entry of each key in a segment, table metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import cuts, range_of

#: Sequence numbers that one task walks through, and as many for each key of a memtable at least.
STRETCH, PER_KEY = 200_000, 100


def fixed_segments(log: DataFrame, size: int = 128, start: int = 0) -> DataFrame:
    """log with file_number: the segment of `size` sequence numbers. Where keys do not repeat in a segment, these are the
    memtable's own borders; reads do not depend on where the borders are."""
    return log.withColumn("file_number", F.floor((F.col("seq") - start) / size).cast("long"))


def _summing(capacity: int):
    """The function that sums up each stretch of the log for the others: the first `capacity` distinct keys in order of
    appearance; for a border before any of them and one after each, its number, how many segments start from there on and
    where the last does; the `capacity` keys seen last and where. Places count from 0."""

    def next_starts(codes: list[int], n_codes: int) -> list[int]:
        """For each place, where the segment after one that starts there would start: len(codes) if not in here."""
        starts, held, distinct, end = [], [0] * n_codes, 0, 0
        for code in codes:
            while end < len(codes) and distinct < capacity:
                distinct += not held[codes[end]]
                held[codes[end]] += 1
                end += 1
            starts.append(end if distinct == capacity else len(codes))
            held[code] -= 1
            distinct -= not held[code]
        return starts

    def summed(stretch: int, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq", na_position="first")
        codes, names = pd.factorize(frame["key"], use_na_sentinel=False)
        codes, names, seqs = codes.tolist(), [None if pd.isna(k) else k for k in names], frame["seq"].tolist()
        n, starts = len(codes), next_starts(codes, len(names))
        segments, last = [1] * n + [0], [*range(n + 1)]
        for place in range(n - 1, -1, -1):
            if starts[place] < n:
                segments[place], last[place] = segments[starts[place]] + 1, last[starts[place]]
        first_at, last_at = dict(zip(reversed(codes), range(n - 1, -1, -1))), dict(zip(codes, range(n)))
        borders = [0] + [first_at[c] + 1 for c in range(min(capacity, len(names)))]
        newest = sorted(last_at, key=last_at.get)[-capacity:]
        row = {"stretch": stretch, "keys": names[:capacity], "numbers": [seqs[b] if b < n else None for b in borders]}
        row |= {"segments": [segments[b] for b in borders], "last": [last[b] for b in borders]}
        return pd.DataFrame([row | {"newest": [names[c] for c in newest], "places": [last_at[c] for c in newest]}])

    def run(frames):
        whole = [*frames]
        for stretch, frame in pd.concat(whole).groupby("stretch") if whole else []:
            yield summed(stretch, frame)

    return run


_SUMMARY = "stretch int, keys array<string>, numbers array<bigint>, segments array<int>, last array<int>, newest array<string>, places array<int>"


def _starts(summaries: list, capacity: int) -> dict:
    """For each stretch, the file number it starts with and the sequence number of its first border (none: no border)."""
    starts, number, seen = {}, 0, set()
    for s in sorted(summaries, key=lambda s: s["stretch"]):
        fresh = [j for j, key in enumerate(s["keys"], 1) if key not in seen]
        need = capacity - len(seen)
        border = 0 if need == 0 else fresh[need - 1] if need <= len(fresh) else None
        seq = None if border is None else s["numbers"][border]
        starts[s["stretch"]] = (number, seq)
        if seq is None:
            seen |= set(s["keys"])
        else:
            number += s["segments"][border]
            seen = {key for key, place in zip(s["newest"], s["places"]) if place >= s["last"][border]}
    return starts


def exact_segments(log: DataFrame, capacity: int) -> DataFrame:
    """log with file_number as a memtable of `capacity` distinct keys gives it: when it is full, the next mutation, even an
    overwrite, flushes first. Borders depend on the one before: stretches of the log are summed up for every segment that may
    be open at their start, the driver links the summaries (a row of at most 2 * capacity keys for each stretch), and then
    each stretch is walked through from its first border. For logs whose borders must be reproduced; bulk loads can use
    fixed_segments."""
    log = log.select("key", "val", "tombstone", "seq")
    edges = cuts(log, "seq", max(STRETCH, PER_KEY * capacity))
    log = log.withColumn("stretch", range_of(F.col("seq"), edges))
    # one task for each stretch, also where few bytes would share one
    dealt = lambda rows: rows.repartitionById(len(edges) + 1, F.col("stretch"))
    starts = _starts(dealt(log.select("key", "seq", "stretch")).mapInPandas(_summing(capacity), _SUMMARY).collect(), capacity)

    def run(frames):
        at, number, border, seen = None, 0, None, None
        for frame in frames:
            out = []
            for key, seq, stretch in zip(frame["key"], frame["seq"], frame["stretch"]):
                if stretch != at:
                    at, (number, border), seen = stretch, starts[stretch], None
                if seen is None and seq == border or seen is not None and len(seen) == capacity:
                    number, seen = number + 1, set()
                if seen is not None:
                    seen.add(key)
                out.append(number)
            yield pd.DataFrame({"key": frame["key"], "val": frame["val"], "tombstone": frame["tombstone"], "seq": frame["seq"], "file_number": out})

    ordered = dealt(log).sortWithinPartitions("seq")
    return ordered.mapInPandas(run, "key string, val string, tombstone boolean, seq bigint, file_number bigint")


def flushed(segmented: DataFrame, level: int = 0) -> DataFrame:
    """One table per segment: newest entry of each key, tombstones kept."""
    last = F.max_by(F.struct("val", "tombstone"), "seq").alias("last")
    rows = segmented.groupBy("file_number", "key").agg(last, F.max("seq").alias("seq"))
    return rows.select("key", "last.val", "last.tombstone", "file_number", F.lit(level).alias("level"), "seq")


def metadata(tables: DataFrame) -> DataFrame:
    """One manifest row per table; the time of a table is that of its newest mutation number here."""
    return tables.groupBy("file_number", "level").agg(
        F.max("seq").alias("ts_ms"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_entries")
    )
