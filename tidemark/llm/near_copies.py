"""Near-duplicate documents by BagMinHash over multisets of five-word shingles, bands, and exact verification.

Signature. A shingle of multiplicity w covers [0, w) of a weight axis that is cut at 0, 1, 2, 4, 8, ... Each cell of each
shingle has a Poisson process of its own, whose points carry a register and a place in the cell; a document has the points
with places below w. The smallest point of each register is the signature; registers of two documents agree with
probability equal to their weighted Jaccard similarity. Points come in increasing order and stop at the document's
largest register, so that long documents look at about one point per shingle.

Search. Documents that share a band, directly or through others, are a family. A family of one chunk is one group in which
all overlaps of shingle multisets are counted exactly, as a product of incidence matrices, so that every link is verified
and no pair leaves a task; spanning links do.

A larger family is first compared with a leader, the document that most others share a band with: what is linked to it is
done. Weighted Jaccard distances obey the triangle inequality, so a document that is not linked to the leader can only be
linked to one that is if its own distance from the leader is at most twice the limit; those few are compared with the linked
ones. What is left gets another leader, as long as leaders take a good part of it, so that a group of near copies costs in
proportion to its size. Then the rest meets as chunks, every pair of chunks as one group; it is cut by size before, as
similar documents have similar sizes, and chunks of far sizes never meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, written
from .components import components
from .words import joined, spread, word_hashes, word_spans

WIDTH, LEAST = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of 7e-6.
BANDS, ROWS = 30, 5
#: Leaders go on while they take this part of what large families have left.
TAKEN = 0.05
#: Documents and shingles of a chunk; shingles that are multiplied at a time; bytes of text that a task signs at a time.
CHUNK, CHUNK_SHINGLES, COLUMNS, BLOCK = 1000, 400_000, 4096, 1_500_000


def shingles(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text numbers, hashes, multiplicities (ordered by text, then hash), and each text's
    number of shingles. A text of fewer words than `width`, but one at least, is one shingle; without words it has none."""
    data, starts = joined(texts)
    first, last, at = word_spans(data, starts)
    h = word_hashes(data, first, last)
    n_words = np.diff(at)
    mixed = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - k)] = h[k:]
        mixed = spread(mixed * np.uint64(3) + part)
    owner = np.repeat(np.arange(len(texts)), n_words)
    good = np.arange(len(h)) + width <= np.repeat(at[1:], n_words)
    doc, value = owner[good], mixed[good]
    few = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(few):
        own = np.array([np.bitwise_xor.reduce(spread(h[at[k] : at[k + 1]] + np.arange(at[k + 1] - at[k], dtype=np.uint64))) for k in few], np.uint64)
        doc, value = np.concatenate([doc, few]), np.concatenate([value, spread(own)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    place = np.flatnonzero(new)
    times = np.diff(np.append(place, len(doc)))
    return doc[place], value[place], times, np.bincount(doc, minlength=len(texts))


def signatures(doc: np.ndarray, value: np.ndarray, times: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """BagMinHash: the smallest point of each register (infinite where a text has no shingle)."""
    cells = [(np.arange(len(doc)), 0)]
    level = 1
    while len(more := np.flatnonzero(times > (1 << (level - 1)))):
        cells.append((more, level))
        level += 1
    row = np.concatenate([c for c, _ in cells])
    level_of = np.concatenate([np.full(len(c), k) for c, k in cells])
    low = np.where(level_of > 0, 1 << np.maximum(level_of - 1, 0), 0)
    rate = np.where(level_of > 0, 1 << np.maximum(level_of - 1, 0), 1).astype(float)
    seed = spread(value[row] + level_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    d, weight = doc[row], times[row]
    x = np.zeros(len(row))
    table = np.full(n_texts * registers, np.inf)
    limit = np.full(n_texts, np.inf)
    step = 0
    while len(row):
        step += 1
        u = spread(seed + np.uint64(step * 0xA0761D6478BD642F % (1 << 64)))
        x = x - np.log1p(-(u >> np.uint64(11)).astype(float) * 2.0**-53) / rate
        u = spread(u ^ np.uint64(0xE7037ED1A0B428DB))
        place = low + (u >> np.uint64(40)).astype(float) * 2.0**-24 * rate
        kept = (place < weight) & (x < limit[d])
        key = d[kept] * registers + (u[kept] & np.uint64(0xFFFFFFFF)).astype(np.int64) % registers
        np.minimum.at(table, key, x[kept])
        limit = table.reshape(n_texts, registers).max(axis=1)
        going = x < limit[d]
        if not going.all():
            row = row[going]
            seed, d, weight, x, low, rate = seed[going], d[going], weight[going], x[going], low[going], rate[going]
    return table.reshape(n_texts, registers)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, content, n_shingles, bands) of (doc_id, text): content is a 128-bit digest of the text, bands the hashes of
    its signature's bands; both empty where the text has no word."""

    def run(batches):
        registers = BANDS * ROWS
        for batch in batches:
            many = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            for a, b in slices(np.fromiter(map(len, many), np.int64, len(many)), BLOCK):
                part = many[a:b]
                doc, value, times, count = shingles(part)
                table = signatures(doc, value, times, len(part), registers).view(np.uint64).reshape(len(part), BANDS, ROWS)
                h = np.arange(BANDS, dtype=np.uint64)[None].repeat(len(part), 0)
                for k in range(ROWS):
                    h = spread(h * np.uint64(5) + table[:, :, k])
                full = count > 0
                offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array([xxhash.xxh3_128_hexdigest(x) if ok else "" for x, ok in zip(part, full)], pa.string()),
                        pa.array(count, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[full].ravel().view(np.int64))),
                    ],
                    names=["doc_id", "content", "n_shingles", "bands"],
                )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, content string, n_shingles bigint, bands array<bigint>")


def overlaps(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact multiset overlaps of sets (hashes, multiplicities) `left` by `right`. The copies of a shingle are columns of
    their own, so that a product of incidences sums the smaller multiplicities; columns of one document are left out."""
    doc = np.repeat(np.arange(len(sets)), [int(t.sum()) for _, t in sets])
    value = np.concatenate([np.repeat(v, t) for v, t in sets])
    copy = np.concatenate([np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) for _, t in sets]).astype(np.uint64)
    _, column, met = np.unique(spread(value + copy * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    shared = met[column] > 1
    number = np.cumsum(met > 1) - 1
    doc, column = doc[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        part[doc[a:b], column[a:b] - at] = 1
        total += part[left] @ part[right].T
    return total


def _spanning(node: np.ndarray, other: np.ndarray, size: int) -> np.ndarray:
    """The smallest number that each of `size` nodes reaches by the links."""
    label = np.arange(size)
    while True:
        before = label.copy()
        least = np.minimum(label[node], label[other])
        np.minimum.at(label, node, least)
        np.minimum.at(label, other, least)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


_GROUP = ["family", "low", "high", "i", "j"]


def _sets(data: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Shingles and multiplicities of each packed text, and its number of shingles."""
    unpack = zstandard.ZstdDecompressor().decompress
    doc, value, times, count = shingles([unpack(x) for x in data])
    at = np.searchsorted(doc, np.arange(len(data) + 1))
    return [(value[x:y], times[x:y]) for x, y in zip(at, at[1:])], count


def _by_group(rows: DataFrame, found, names: tuple[str, str, str], schema: str) -> DataFrame:
    """found(doc_ids, sides, packed texts) of each whole group, as rows (x, y, z)."""

    def run(batches):
        held: list[tuple] = []
        current = None

        def told():
            out = list(zip(*found(*map(list, zip(*held))))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=list(names))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != current and held:
                    yield told()
                    held.clear()
                current = row[:5]
                held.append((row[6], row[5], row[7]))
        if held:
            yield told()
        release()

    dealt = rows.select(*_GROUP, "side", "doc_id", "packed").repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, schema)


def family_links(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Spanning links (a, b) of the verified links in each group of (family, low, high, i, j, side, doc_id, packed): side 0
    against side 1, or, where there is only side 0, all pairs."""

    def links(ids: list[int], sides: list[int], data: list[bytes]):
        sets, count = _sets(data)
        side = np.array(sides)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        both = overlaps(sets, left, right)
        i, j = np.nonzero((both > 0) & (both >= least * (count[left][:, None] + count[right][None] - both) - 1e-3))
        i, j, n = left[i], right[j], both[i, j].astype(np.int64)
        good = (i != j) & (n >= least * (count[i] + count[j] - n))
        label = _spanning(i[good], j[good], len(ids))
        return [(ids[k], ids[m], 1.0) for k, m in enumerate(label.tolist()) if k != m]

    return _by_group(rows, links, ("a", "b", "likeness"), "a bigint, b bigint, likeness double").select("a", "b")


def led(rows: DataFrame) -> DataFrame:
    """(doc_id, leader, likeness) of every document of side 1 in groups like those above, which have one leader, side 0."""

    def likeness(ids: list[int], sides: list[int], data: list[bytes]):
        sets, count = _sets(data)
        head = sides.index(0)
        others = np.array([k for k, side in enumerate(sides) if side], np.int64)
        if not len(others):
            return []
        both = overlaps(sets, np.array([head]), others)[0].astype(np.int64)
        return [(ids[k], ids[head], float(n / (count[k] + count[head] - n))) for k, n in zip(others.tolist(), both.tolist())]

    return _by_group(rows, likeness, ("doc_id", "leader", "likeness"), "doc_id bigint, leader bigint, likeness double")


def _chunks() -> Column:
    return F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int")


def _slot(chunks: str) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(chunks)).cast("int")


def _every(chunks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(chunks) - 1))


def _after_leaders(members: DataFrame, packed: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """What leaders leave of (doc_id, family, n_shingles, weight), the links (a, b) with them, and the groups in which
    documents that a leader does not take meet those that it takes."""
    rest, links, groups = members, [], []
    limit = 1 - least + 1e-9
    while True:
        large = rest.groupBy("family").agg(_chunks().alias("all"), F.count("*").alias("n"), F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("leader")).where(F.col("all") > 1)
        large = written(large, "leaders")
        many = large.agg(F.sum("n")).first()[0]
        if not many:
            break
        own = rest.join(large, "family")
        rows = own.where("doc_id != leader").select("doc_id", "family", _slot("all").alias("i"), F.lit(1).alias("side"))
        rows = rows.unionByName(large.select(F.col("leader").alias("doc_id"), "family", _every("all").alias("i"), F.lit(0).alias("side")))
        rows = rows.withColumns({c: F.lit(0) for c in ("low", "high", "j")})
        seen = led(rows.join(packed, "doc_id")).join(rest.select("doc_id", "family", "n_shingles"), "doc_id")
        seen = written(seen, "led")
        taken, left = seen.where(F.col("likeness") >= least), seen.where((F.col("likeness") < least) & (F.col("likeness") >= 1 - 2 * limit))
        links.append(taken.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
        near = left.groupBy("family").agg(_chunks().alias("lefts"), F.max("likeness").alias("most"))
        takers = written(taken.join(near, "family").where(F.col("likeness") <= F.col("most") + limit).groupBy("family", "lefts", "most").agg(_chunks().alias("rights")), "takers")
        group = {"low": F.lit(-1), "high": F.lit(len(links))}
        lefts = left.join(takers, "family").select("doc_id", "family", _slot("lefts").alias("i"), _every("rights").alias("j"), F.lit(0).alias("side"))
        rights = taken.join(takers, "family").where(F.col("likeness") <= F.col("most") + limit)
        rights = rights.select("doc_id", "family", _every("lefts").alias("i"), _slot("rights").alias("j"), F.lit(1).alias("side"))
        groups.append(lefts.unionByName(rights).withColumns(group))
        gone = taken.select("doc_id").unionByName(large.select(F.col("leader").alias("doc_id")))
        rest = written(rest.join(gone, "doc_id", "left_anti"), "rest")
        if taken.count() < TAKEN * many:
            break
    return rest, links, groups


def _groups(members: DataFrame, least: float) -> DataFrame:
    """Where each of (doc_id, family, n_shingles) goes: (doc_id, family, low, high, i, j, side)."""
    sizes = members.groupBy("family").agg(_chunks().alias("all"))
    slot = F.when(F.col("all") > 1, F.floor(F.log("n_shingles") / float(np.log(1 / least)))).otherwise(0).cast("int")
    rows = members.join(written(sizes, "families"), "family").withColumn("slot", slot).select("doc_id", "family", "slot", "n_shingles")
    counts = written(rows.groupBy("family", "slot").agg(_chunks().alias("chunks")), "slots")
    after = counts.select("family", (F.col("slot") - 1).alias("slot"), F.col("chunks").alias("after"))
    before = counts.select("family", (F.col("slot") + 1).alias("slot"), F.col("chunks").alias("before"))
    around = counts.join(after, ["family", "slot"], "left").join(before, ["family", "slot"], "left")
    rows = rows.join(written(around, "slots"), ["family", "slot"]).withColumn("c", _slot("chunks"))
    own = F.col("slot")
    same = rows.select("doc_id", "family", own.alias("low"), own.alias("high"), "c", _every("chunks").alias("d"))
    same = same.select("doc_id", "family", "low", "high", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), F.when(F.col("c") <= F.col("d"), 0).otherwise(1).alias("side"))
    up = rows.where("after IS NOT NULL").select("doc_id", "family", own.alias("low"), (own + 1).alias("high"), F.col("c").alias("i"), _every("after").alias("j"), F.lit(0).alias("side"))
    down = rows.where("before IS NOT NULL").select("doc_id", "family", (own - 1).alias("low"), own.alias("high"), _every("before").alias("i"), F.col("c").alias("j"), F.lit(1).alias("side"))
    return same.unionByName(up).unionByName(down)


def _pack(docs: DataFrame) -> DataFrame:
    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data = [packer.compress((x or "").encode("utf-8", "surrogatepass")) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "packed"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, packed binary")


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, component_id, kept): the smallest doc_id that is reached by links of similarity `least` or more, one row
    per row of (doc_id, text). Documents without words (null, empty, blank) link with nothing; equal texts always link;
    a doc_id stands for one text (of several, one that does not depend on their order); rows without one are kept; an empty
    table gives no rows. Extra columns are ignored."""
    sig = written(signed(docs), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = written(full.groupBy("content").agg(F.min("doc_id").alias("first")), "firsts")
    single = full.join(firsts.select(F.col("first").alias("doc_id"), "content"), ["doc_id", "content"], "left_semi")
    rows = single.select("doc_id", F.explode("bands").alias("band"))
    heads = written(rows.groupBy("band").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("band", "head"), "buckets")
    met = written(rows.join(heads, "band").where("doc_id != head").select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct(), "met")
    families = components(met).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    weight = written(met.groupBy(F.col("b").alias("doc_id")).agg(F.count("*").alias("weight")), "weights")
    members = families.join(single.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id").join(weight, "doc_id", "left")
    members = written(members.fillna(0, ["weight"]), "members")
    packed = written(_pack(docs).join(members.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("packed").alias("packed")), "packed")
    rest, links, groups = _after_leaders(members, packed, least)
    for more in [_groups(rest, least), *groups]:
        links.append(family_links(more.join(packed, "doc_id"), least))
    links = written(reduce(DataFrame.unionByName, links), "links")
    part = components(links)
    own = full.select("doc_id", "content").join(firsts, "content").groupBy("doc_id").agg(F.min("first").alias("first"))
    out = sig.select("doc_id").join(own, "doc_id", "left").join(part, F.col("first") == F.col("node"), "left")
    component = F.coalesce("component", "first", "doc_id")
    return out.select("doc_id", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))
