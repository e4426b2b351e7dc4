"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated by a seeded orthogonal matrix and cut into blocks of a few dimensions. Two vectors whose squared
distance is at most D have a block whose squared distance is at most D times the block's share of the dimensions, so each
block is range-joined under this budget: its first two coordinates are cut into tiles, a vector is at home in one tile and
a visitor where it lies within the block's radius of another. In a tile, the next two coordinates tell which vectors are in
reach of each other, and pairs of these within the block's budget are candidates; their cosine is computed from the whole
vectors as they are, in double precision. A pair counts in the first block that proposes it, so the union needs no pass of
its own and no pairs leave a task: only link counts and spanning links do.

Equal vectors of a label are one vector with a count, so a group of copies, however large, is one row. A tile of many
vectors is cut into chunks whose pairs are separate tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

LEAST = 0.98
#: Dimensions of a block, tile width in radii, vectors of a tile's chunk.
BLOCK_DIMS, TILE_RADII, CHUNK = 16, 3.0, 8192
#: A tile of at most STRIP by STRIP vectors is compared as a whole; left vectors of a cell that are compared at a time.
STRIP, CELL = 64, 512
_SLACK = 1e-9
#: Sides of a chunk pair that a row takes.
LEFT, RIGHT, BOTH = 0, 1, 2


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[slice]:
    edges = list(range(0, max(1, dims - BLOCK_DIMS + 1), BLOCK_DIMS)) + [dims]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _units(raw: list[bytes], dims: int) -> np.ndarray:
    kind = np.float32 if len(raw[0]) == 4 * dims else np.float64
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dims).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dims, raw): raw holds the components as they are, or, doubles, scaled against over- and underflow by a
    power of two; dims is 0 for vectors that can link with nothing."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"

    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            dims, raw = [], []
            for vec_id, vector, label in zip(ids, batch.column(1), labels):
                values = vector.values if vector.is_valid else None
                x = np.zeros(0)
                if values is not None and len(values) and not values.null_count and label is not None and vec_id is not None:
                    x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if not np.isfinite(x).all() or not x.any():
                        x = np.zeros(0)
                    elif single:
                        x = (x + 0.0).astype(np.float32)
                    else:
                        x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
                dims.append(len(x))
                raw.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(labels, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dims", "raw"]
            )

    return vectors.select("vec_id", "embedding", F.col("label").cast("long")).mapInArrow(run, "vec_id bigint, label bigint, dims int, raw binary")


_PLACE = "label bigint, dims int, block int, x int, y int"
_PLACES = [p.split()[0] for p in _PLACE.split(", ")]


def _tiles(distinct: DataFrame, least: float) -> DataFrame:
    """Every place of every distinct vector: a home per block, visits to earlier tiles next to it. own_x, own_y: the home."""

    def run(batches):
        for batch in batches:
            label, dims_of, first, n, raw = (batch.column(k).to_pylist() for k in range(5))
            for dims in sorted(set(dims_of)):
                who = np.flatnonzero(np.array(dims_of) == dims)
                z = _units([raw[k] for k in who], dims) @ rotation(dims)
                for b, part in enumerate(blocks(dims)):
                    radius = np.sqrt((2 - 2 * least) * (part.stop - part.start) / dims) + _SLACK
                    c = z[:, part][:, :2]
                    if c.shape[1] < 2:
                        c = np.hstack([c, np.zeros((len(c), 1))])
                    own = np.floor(c / (TILE_RADII * radius)).astype(np.int64)
                    for step in ((0, 0), (0, -1), (-1, -1), (-1, 0), (-1, 1)):  # a pair across tiles counts in the first of them
                        tile = own + step
                        low, high = tile * TILE_RADII * radius - radius, (tile + 1) * TILE_RADII * radius + radius
                        k = np.flatnonzero(((c >= low) & (c <= high)).all(axis=1))
                        if not len(k):
                            continue
                        at = who[k]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([label[i] for i in at], pa.int64()),
                                pa.array(np.full(len(k), dims, np.int32)),
                                pa.array(np.full(len(k), b, np.int32)),
                                pa.array(tile[k, 0].astype(np.int32)),
                                pa.array(tile[k, 1].astype(np.int32)),
                                pa.array(own[k, 0].astype(np.int32)),
                                pa.array(own[k, 1].astype(np.int32)),
                                pa.array([first[i] for i in at], pa.int64()),
                                pa.array([n[i] for i in at], pa.int64()),
                                pa.array([raw[i] for i in at], pa.binary()),
                            ],
                            names=[*_PLACES, "own_x", "own_y", "first", "n", "raw"],
                        )

    return distinct.select("label", "dims", "first", "n", "raw").mapInArrow(run, f"{_PLACE}, own_x int, own_y int, first bigint, n bigint, raw binary")


def _stars(node: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """The smallest number that each of `size` nodes reaches by the links."""
    label = np.arange(size)
    while True:
        least = np.minimum(label[node], label[other])
        before = label.copy()
        np.minimum.at(label, node, least)
        np.minimum.at(label, other, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def _strips(left: np.ndarray, right: np.ndarray, width: float):
    """Of two sets of points by two coordinates: (rows of left, low, high) so that every pair that differs by at most
    `width` in both has its left point in rows and its right one in low to high of `order`, which comes first. Points lie
    in cells of half of `width`; those of a cell meet what is in reach in each column of cells that is."""
    few = len(left) * len(right) <= STRIP**2
    size = width / 2
    cell = [np.floor(x / size).astype(np.int64) for x in (left, right)]
    order = np.arange(len(right)) if few else np.lexsort((right[:, 1], cell[1][:, 0]))
    yield order, 0, 0
    if few:
        yield np.arange(len(left)), 0, len(right)
        return
    at, second = cell[1][order, 0], right[order, 1]
    rows = np.lexsort((left[:, 1], cell[0][:, 0]))
    column, row = cell[0][rows, 0], cell[0][rows, 1]
    new = np.ones(len(rows), bool)
    new[1:] = (column[1:] != column[:-1]) | (row[1:] != row[:-1])
    edges = np.append(np.flatnonzero(new), len(rows))
    for a, e in zip(edges.tolist(), edges[1:].tolist()):
        bounds = np.searchsorted(at, column[a] + np.arange(-2, 4)).tolist()
        reach = (left[rows[a], 1] - width, left[rows[e - 1], 1] + width)
        for low, high in zip(bounds, bounds[1:]):
            if low < high:
                x, y = (low + np.searchsorted(second[low:high], reach)).tolist()
                for k in range(a, e if x < y else a, CELL):
                    yield rows[k : min(k + CELL, e)], x, y


def _compared(left: np.ndarray, right: np.ndarray, strips, allowed, b: int, parts: list[slice], budgets: np.ndarray, near):
    """(i, j) of the pairs that block b proposes first and that are near, strip by strip; after each strip, as the third,
    how many block distances it took. right is in the order of the strips."""
    part = parts[b]
    square = (right[:, part] ** 2).sum(axis=1)
    for rows, low, high in strips:
        strip = left[rows, part]
        close = (strip**2).sum(axis=1)[:, None] + square[None, low:high] - 2 * strip @ right[low:high, part].T <= budgets[b]
        i, j = np.nonzero(close & allowed(rows, low, high))
        i, j = rows[i], j + low
        for k in range(0, len(i), 20_000):
            x, y = i[k : k + 20_000], j[k : k + 20_000]
            good = near(x, y)
            x, y = x[good], y[good]
            if b:
                earlier = np.add.reduceat((left[x] - right[y]) ** 2, [p.start for p in parts], axis=1)[:, :b] <= budgets[:b]
                first = ~earlier.any(axis=1)
                x, y = x[first], y[first]
            yield x, y, 0
        yield i[:0], j[:0], len(rows) * (high - low)


def _tile_links(rows: DataFrame, least: float, distances: Accumulator | None = None) -> DataFrame:
    """Of the rows of whole chunk pairs: (a, b, n): n links more for a (b null), or a spanning link a-b (n null)."""
    keys = [*_PLACES, "i", "j"]

    def tile(key: tuple, own: list[np.ndarray], n: np.ndarray, first: np.ndarray, raw: list[bytes], side: np.ndarray):
        dims, b = key[1], key[2]
        parts = blocks(dims)
        budgets = np.array([(2 - 2 * least) * (p.stop - p.start) / dims for p in parts]) + _SLACK
        turned = rotation(dims)
        plain = _units(raw, dims)
        z = plain @ turned
        lefts, rights = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
        if not len(lefts) or not len(rights):
            return
        inside = z[:, [min(parts[b].start + k, parts[b].stop - 1) for k in (2, 3)]]
        strips = _strips(inside[lefts], inside[rights], np.sqrt(budgets[b]))
        rights = rights[next(strips)[0]]
        visits = (own[0][rights] != key[3]) | (own[1][rights] != key[4])

        def allowed(rows, low, high):  # two at home in one chunk: once
            if key[5] != key[6]:
                return np.ones((len(rows), high - low), bool)
            return visits[None, low:high] | (first[lefts[rows], None] < first[rights[low:high]][None])

        def near(i, j):  # on the vectors as they are: turning them moves a cosine by rounding
            return np.einsum("ij,ij->i", plain[lefts[i]], plain[rights[j]]) >= least

        ids = np.unique(first)
        total = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))
        for i, j, took in _compared(z[lefts], z[rights], strips, allowed, b, parts, budgets, near):
            if took and distances is not None:
                distances.add(took)
            if not len(i):
                continue
            x, y = np.searchsorted(ids, first[lefts[i]]), np.searchsorted(ids, first[rights[j]])
            np.add.at(total, x, n[rights[j]])
            np.add.at(total, y, n[lefts[i]])
            label = _stars(np.concatenate([x, np.arange(len(ids))]), np.concatenate([y, label]), len(ids))
        some, star = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(ids)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(total[some])], names=["a", "b", "n"])
        if len(star):
            yield pa.RecordBatch.from_arrays([pa.array(ids[star]), pa.array(ids[label[star]]), pa.nulls(len(star), pa.int64())], names=["a", "b", "n"])

    def run(batches):
        held: list[tuple] = []
        current = None

        def told():
            columns = list(zip(*held))
            return tile(current, [np.array(columns[0]), np.array(columns[1])], np.array(columns[3]), np.array(columns[2]), list(columns[4]), np.array(columns[5]))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key = row[:7]
                if key != current and held:
                    yield from told()
                    held.clear()
                current = key
                held.append(row[7:])
        if held:
            yield from told()

    dealt = rows.select(*keys, "own_x", "own_y", "first", "n", "raw", "side").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, least: float = LEAST, distances: Accumulator | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of (vec_id, embedding, label): links join vectors of one label
    and length whose cosine is at least `least`.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows of null label or id, link with
    nothing. Equal vectors link with each other; a repeated row counts as another vector. Extra columns are ignored; an
    empty table gives no rows. `distances`, where given, is told how many distances within a block were computed.
    """
    rows = written(prepared(vectors), "vectors")
    distinct = rows.where("dims > 0").groupBy("label", "dims", "raw").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    distinct = written(distinct, "distinct")
    places = written(_tiles(distinct, least), "places")
    crowd = places.groupBy(*_PLACES).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.count("*").alias("crowd"), F.max((F.col("x") == F.col("own_x")) & (F.col("y") == F.col("own_y"))).alias("lived"))
    placed = places.join(crowd.where("crowd > 1 AND lived"), _PLACES).withColumn("c", F.pmod(F.xxhash64("first"), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    home = (F.col("x") == F.col("own_x")) & (F.col("y") == F.col("own_y"))
    # chunk pair (i, j): those at home in i against those at home in j (i <= j) and the visitors of j
    both = placed.where(home).select("*", F.col("c").alias("i"), F.col("c").alias("j"), F.lit(BOTH).alias("side"))
    lefts = placed.where(home & (F.col("chunks") > 1)).select("*", F.col("c").alias("i"), every.alias("j"), F.lit(LEFT).alias("side")).where("i != j")
    rights = placed.where(~home | (F.col("chunks") > 1)).select("*", every.alias("i"), F.col("c").alias("j"), F.lit(RIGHT).alias("side"))
    rights = rights.where(~home | (F.col("i") < F.col("j")))
    found = written(_tile_links(both.unionByName(lefts).unionByName(rights), least, distances), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("more"))
    part = components(found.where("b IS NOT NULL").select("a", "b"))
    known = distinct.join(counts, "first", "left").join(part, F.col("first") == F.col("node"), "left").select(
        "label", "dims", "raw", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")
    )
    return rows.join(known, ["label", "dims", "raw"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
