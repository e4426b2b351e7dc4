"""Repeated windows of any documents: what byte and word dedup share.

A window is W consecutive elements (bytes or words) of one document. Each window names an anchor inside it that depends on
the window's content alone, so equal windows have equal anchors at equal places; consecutive windows of one anchor are a
stretch. Stretches are dealt by their anchor's name; a name that only one place has is dropped. Of the others the elements
are fetched and their windows compared. The result is spans of window starts, which are applied to the texts.

Before the shuffle each task keeps one stretch of each content, so that copies, however many, meet once per task. Hashes
only propose: a task drops a stretch if its bytes are those of the one it keeps, and the comparison verifies windows by
their elements, so no element goes because hashes agree.

One anchor may have any number of contents. Where a task sees many of one anchor, it deals them by anchor and content and
leaves a mark under the anchor, so that the rest of this anchor's stretches is compared too. Before the comparison the
stretches of anchors with more than MANY are cut into parts, of fewer and fewer windows: a part is named by the anchor and
by the elements that all its windows share, so equal windows still meet, and parts of one window at last are equal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, with_field, written
from .words import spread

#: Stretches that a task gathers before it sends them; bytes of text that it looks at a time; bytes compared at a time.
GATHERED, BLOCK, COMPARED = 800_000, 1_000_000, 1_500_000

#: Stretches whose contents, and parts of stretches, that a task holds at a time.
FETCHED, PARTS = 10_000, 50_000

#: Contents of one key in a gathering from which they are dealt by content; stretches of a key that are compared in one task.
HOT, MANY = 16, 1000

#: kind: open, known as a repeat, dealt by content, or the mark of a key of which some are.
OPEN, KNOWN, DEALT, MARK = range(4)

_STRETCH = "key bigint, tag bigint, doc_id bigint, start int, n int, anchor int, kind tinyint"
_NAMES = [x.split()[0] for x in _STRETCH.split(", ")]
_TYPES = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int8)


def _record(columns: list[np.ndarray], names: list[str] = _NAMES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes from a are those from b, eight at a time; every size is 8 at least."""
    words = np.ndarray((max(len(data) - 7, 0),), np.uint64, data, 0, (1,))
    out = np.ones(len(a), bool)
    open_ = np.arange(len(a))
    for k in range(0, int(size.max()) if len(size) else 0, 8):
        open_ = open_[size[open_] > k]
        at = np.minimum(k, size[open_] - 8)
        out[open_] &= words[a[open_] + at] == words[b[open_] + at]
    return out


def _once(columns: list[np.ndarray], data: np.ndarray) -> list[np.ndarray]:
    """Marks as known repeats the stretches that hold the same bytes as an earlier one among those gathered, and as dealt by
    content those of keys with more than HOT contents. The last two columns are each stretch's place and size in data."""
    key, tag, doc, start = columns[:4]
    low, size = columns[6:]
    order = np.arange(len(key))
    if (np.diff(doc) < 0).any():
        order = np.lexsort((start, doc))
    order = order[np.lexsort((tag[order], key[order]))]
    new_key, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_key[1:] = key[order[1:]] != key[order[:-1]]
    new[1:] = new_key[1:] | (tag[order[1:]] != tag[order[:-1]])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    group = np.cumsum(new_key) - 1
    hot = (np.bincount(group, new) > HOT)[group]
    kind = np.full(len(order), OPEN, np.int8)
    kind[order[hot]] = DEALT
    again = np.flatnonzero(~new)
    same = (doc[order[again]] == doc[head[again]]) & (start[order[again]] == start[head[again]])
    twice = order[again[same]]  # a repeated row repeats nothing
    again = again[~same]
    again = again[size[order[again]] == size[head[again]]]
    known = order[again[_equal(data, low[order[again]], low[head[again]], size[order[again]])]]
    kind[known] = KNOWN
    marked = key[order[new_key & hot]]
    least = np.full(len(marked), np.iinfo(np.int64).min)
    none = np.zeros(len(marked), np.int32)
    marks = [marked, least, least, none - 1, none, none, np.full(len(marked), MARK, np.int8)]
    # what is known need not meet the others: it is dealt anywhere
    key = key.copy()
    key[known] = spread(doc[known].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[known].astype(np.uint64)).view(np.int64)
    left = np.ones(len(key), bool)
    left[twice] = False
    return [np.concatenate(c) for c in zip([c[left] for c in (key, *columns[1:6], kind)], marks)]


def identity(text: str = "text") -> Column:
    """The number under which a document's stretches go: its doc_id, or, where that is null, a number below all others that
    depends on the text, so that different texts without an id stay apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))


def _pack(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, doc_id, packed, *carry): identity and zstd of each text."""
    schema = with_field(docs.select(*carry), ("id", "bigint"), ("doc_id", "bigint"), ("packed", "binary"))

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data = [packer.compress((x or "").encode("utf-8", "surrogatepass")) for x in part.column(2).to_pylist()]
                columns = [*(part.column(3 + k) for k in range(len(carry))), part.column(0), part.column(1), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, "id", "doc_id", "packed"])
        release()

    rows = docs.select(identity().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    return rows.mapInArrow(run, schema).select("id", "doc_id", "packed", *carry)


def _stretches(docs: DataFrame, stretches_of: Callable) -> DataFrame:
    def run(batches):
        held: list[list[np.ndarray]] = []
        blocks: list[np.ndarray] = []
        count = total = 0

        def told():
            yield from _parts(_once([np.concatenate(c) for c in zip(*held)], np.concatenate(blocks)))

        for batch in batches:
            many = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            number = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(np.fromiter(map(len, many), np.int64, len(many)), BLOCK):
                key, tag, doc, start, n, anchor, data, low, size = stretches_of(many[a:b])
                if len(key):
                    held.append([key.view(np.int64), tag.view(np.int64), number[a:b][doc], start.astype(np.int32), n.astype(np.int32), anchor.astype(np.int32), low + total, size.astype(np.int32)])
                    blocks.append(data)
                    count, total = count + len(key), total + len(data)
                if count >= GATHERED:
                    yield from told()
                    held, blocks, count, total = [], [], 0, 0
        if count:
            yield from told()
        held, blocks = [], []
        release()

    return docs.select(identity().alias("id"), "text").mapInArrow(run, _STRETCH)


def _parts(columns: list[np.ndarray], names: list[str] = _NAMES) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        yield _record([c[at : at + 100_000] for c in columns], names)


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of stretches by key, tag and place: the known ones, and as OPEN those of keys that have several, here or by their
    mark. Two rows at most, the first and the last of the last key, are carried from batch to batch."""
    carry: list[np.ndarray] | None = None  # the last column says whether a row has been told
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False).astype(t) for k, t in enumerate(_TYPES)]
        known = rows[6] == KNOWN
        if known.any():
            yield _record([c[known] for c in rows])
            rows = [c[~known] for c in rows]
        if not len(rows[0]):
            continue
        told = np.zeros(len(rows[0]), bool)
        if carry is not None:
            rows = [np.concatenate([c, r]) for c, r in zip(carry, rows)]
            told = np.concatenate([carry[7], told])
        key, mark = rows[0], rows[6] == MARK
        new_key, twice = np.ones(len(key), bool), np.zeros(len(key), bool)
        new_key[1:] = key[1:] != key[:-1]
        twice[1:] = ~new_key[1:]
        for c in (1, 2, 3):  # a repeated row
            twice[1:] &= rows[c][1:] == rows[c][:-1]
        group = np.cumsum(new_key) - 1
        several = (np.bincount(group, ~twice) > 1)[group]
        chosen = (several | (rows[6] == DEALT)) & ~mark & ~twice & ~told
        yield _record([*(c[chosen] for c in rows[:6]), np.full(int(chosen.sum()), OPEN, np.int8)])
        keep = np.unique([np.flatnonzero(new_key)[-1], len(key) - 1])
        carry = [c[keep] for c in rows[:7]] + [(told | chosen | mark | twice)[keep]]
    release()


def _many(rows: DataFrame) -> DataFrame:
    """The keys of more than MANY rows: at most one for MANY rows."""
    return written(rows.groupBy("key").count().where(F.col("count") > MANY).select("key"), "many")


def _cut(rows: list, width: int, content_of: Callable) -> list[tuple]:
    """Parts of stretches (key, doc_id, start, n, anchor, content), like these: the windows that begin from k * width to
    k * width + width - 1 elements before their anchor are one part, named by the elements that stand in all such windows."""
    out = []
    for key, doc, start, n, anchor, content in rows:
        side = (anchor - np.arange(n)) // width
        first = np.flatnonzero(np.diff(side, prepend=-1))
        count = np.diff(np.append(first, n))
        inner = content_of(content, anchor - side[first] * width, np.full(len(first), 2 - width))
        for a, m, s, name, part in zip(first.tolist(), count.tolist(), side[first].tolist(), inner, content_of(content, first, count)):
            named = hashlib.blake2b(name, digest_size=8, key=key.to_bytes(8, "little", signed=True), salt=s.to_bytes(4, "little")).digest()
            out.append((int.from_bytes(named, "little", signed=True), doc, start + a, m, anchor - a, part))
    return out


def _parts_once(parts: list[tuple]) -> pa.RecordBatch:
    """The parts as rows, open for the first of each content (by its bytes) and known for the others."""
    seen: dict[tuple, tuple] = {}
    out: list[tuple] = []
    for key, doc, start, n, anchor, content in sorted(parts, key=lambda x: (x[1], x[2])):
        first = seen.get((key, anchor, content))
        if first is None:
            seen[key, anchor, content] = (doc, start)
            out.append((key, doc, start, n, anchor, content, DEALT))
        elif first != (doc, start):  # a repeated row repeats nothing
            out.append((key, doc, start, n, anchor, None, KNOWN))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CONTENT_TYPES)], names=_CONTENT_NAMES)


_CONTENT = "key bigint, doc_id bigint, start int, n int, anchor int, content binary, kind tinyint"
_CONTENT_NAMES = [x.split()[0] for x in _CONTENT.split(", ")]
_CONTENT_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int8())


def _cut_again(rows: DataFrame, width: int, content_of: Callable) -> DataFrame:
    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += _cut(list(zip(*(batch.column(k).to_pylist() for k in range(6)))), width, content_of)
            if len(held) >= PARTS:
                yield _parts_once(held)
                held = []
        if held:
            yield _parts_once(held)
        held = []
        release()

    return rows.mapInArrow(run, _CONTENT)


def repeated_starts(docs: DataFrame, stretches_of: Callable, content_of: Callable, compare: Callable, widths: tuple[int, ...]) -> DataFrame:
    """(doc_id, spans): the starts of windows that also start earlier (smaller doc_id, or same document and earlier), as
    runs of start and n, by identity; documents without any have no row.

    stretches_of(texts) gives key, tag, text number, first start, number of starts and anchor of each stretch, then bytes,
    and where in these each stretch's content begins and how long it is (8 bytes at least);
    content_of(text, starts, ns) gives the bytes of stretches; compare(keys, docs, starts, ns, anchors, contents) gives,
    for stretches of a few whole keys, (row, offset) of each window that also starts earlier among them. `widths` are the
    windows of a part, falling to 1, each a multiple of the next, into which the stretches of crowded keys are cut.
    """
    where = F.when(F.col("kind") == DEALT, F.xxhash64("key", "tag")).otherwise(F.col("key"))
    dealt = _stretches(docs, stretches_of).repartition(where).sortWithinPartitions("key", "tag", "doc_id", "start")
    found = written(dealt.mapInArrow(_sorted_out, _STRETCH), "stretches")
    opened = found.where(F.col("kind") == OPEN)
    many = _many(opened)
    crowded = not many.isEmpty()
    if crowded:
        opened = opened.join(F.broadcast(many.withColumn("crowded", F.lit(True))), "key", "left").withColumn("crowded", F.col("crowded").isNotNull())
    else:
        opened = opened.withColumn("crowded", F.lit(False))
    open_ = opened.groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", "anchor", "crowded")).alias("own"))
    packed = _pack(docs).drop("doc_id").withColumnRenamed("id", "doc_id")
    fetched = packed.join(open_, "doc_id").select("doc_id", "packed", "own")

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        whole: list[tuple] = []
        content: list[bytes] = []
        parts: list[tuple] = []
        size = 0

        def told():
            key, doc, start, n, anchor, crowded = (np.concatenate(c) for c in zip(*whole))
            numbers = (key, doc, start.astype(np.int32), n.astype(np.int32), anchor.astype(np.int32))
            plain = np.flatnonzero(~crowded)
            at = np.flatnonzero(crowded)
            parts.extend(_cut(list(zip(*(c[at].tolist() for c in numbers), [content[k] for k in at.tolist()])), widths[0], content_of))
            kept = content if not len(at) else [content[k] for k in plain.tolist()]
            arrays = [*(pa.array(c[plain]) for c in numbers), pa.array(kept, pa.binary()), pa.array(np.full(len(plain), OPEN, np.int8))]
            return pa.RecordBatch.from_arrays(arrays, names=_CONTENT_NAMES)

        for batch in batches:
            docs_of, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            own, edge = lists.values, lists.offsets.to_numpy().tolist()
            key, start, n, anchor, crowded = (own.field(x).to_numpy(zero_copy_only=False) for x in ("key", "start", "n", "anchor", "crowded"))
            for k, data in enumerate(batch.column(1)):
                a, b = edge[k], edge[k + 1]
                content += content_of(unpack(data.as_py()), start[a:b], n[a:b])
                whole.append((key[a:b], np.full(b - a, docs_of[k]), start[a:b], n[a:b], anchor[a:b], crowded[a:b]))
                size += b - a
                if size >= FETCHED:
                    yield told()
                    whole, content, size = [], [], 0
                    if len(parts) >= PARTS:
                        yield _parts_once(parts)
                        parts = []
        if size:
            yield told()
        if parts:
            yield _parts_once(parts)
        whole, content, parts = [], [], []
        release()

    contents = fetched.mapInArrow(fetch, _CONTENT)
    spans = found.where(F.col("kind") == KNOWN).select("doc_id", "start", "n")
    if crowded:
        contents = written(contents, "contents")
        parts, contents = contents.where(F.col("kind") != OPEN), contents.where(F.col("kind") == OPEN)
        for width in [*widths[1:], 0]:
            spans = spans.unionByName(parts.where(F.col("kind") == KNOWN).select("doc_id", "start", "n"))
            parts = parts.where(F.col("kind") == DEALT)
            many = _many(parts) if width else None
            if many is None or many.isEmpty():
                contents = contents.unionByName(parts)
                break
            contents = contents.unionByName(parts.join(F.broadcast(many), "key", "left_anti").select(*_CONTENT_NAMES))
            again = parts.join(F.broadcast(many), "key", "left_semi").select(*_CONTENT_NAMES)
            parts = written(_cut_again(again, width, content_of), "parts")
    contents = contents.drop("kind").repartition("key").sortWithinPartitions("key", "doc_id", "start")

    def compared(batches):
        for rows in _whole_keys(batches):
            rows, known = _distinct(rows)
            yield known
            if not len(rows[0]):
                continue
            row, offset = compare(*rows)
            _, doc, start = rows[:3]
            order = np.lexsort((offset, row))
            row, at = row[order], start[row[order]] + offset[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(row)))
            yield _record([doc[row[first]], at[first].astype(np.int32), n.astype(np.int32)], ["doc_id", "start", "n"])
        release()

    more = contents.mapInArrow(compared, "doc_id bigint, start int, n int")
    return spans.unionByName(more).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _distinct(rows: list) -> tuple[list, pa.RecordBatch]:
    """Of the rows of whole keys, by key and place: those that still have to be compared, the first of each content where
    a key has several; and, as spans, all others that are no repeated rows: their bytes stand earlier as a whole."""
    key, doc, start, n, anchor, content = rows
    keys, anchors = key.tolist(), anchor.tolist()
    seen: dict[tuple, int] = {}
    first = np.fromiter((seen.setdefault(x, k) for k, x in enumerate(zip(keys, anchors, content))), np.int64, len(keys))
    own = first == np.arange(len(first))
    known = ~own & ((doc != doc[first]) | (start != start[first]))
    _, group, many = np.unique(key[own], return_inverse=True, return_counts=True)
    left = np.flatnonzero(own)[many[group] > 1]
    spans = _record([doc[known], start[known].astype(np.int32), n[known].astype(np.int32)], ["doc_id", "start", "n"])
    return [*(c[left] for c in (key, doc, start, n, anchor)), [content[k] for k in left.tolist()]], spans


def _whole_keys(batches: Iterator[pa.RecordBatch]):
    """Rows of whole keys, as many as have about COMPARED bytes."""
    held: list[list] = []
    size = 0

    def columns(rows):
        numbers = [np.concatenate([r[k] for r in rows]) for k in range(5)]
        return [*numbers, [x for r in rows for x in r[5]]]

    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)] + [batch.column(5).to_pylist()]
        held.append(rows)
        size += batch.column(5).nbytes
        if size >= COMPARED:
            every = columns(held)
            last = int(np.searchsorted(every[0], every[0][-1]))
            if last:
                yield [c[:last] for c in every]
            held = [[c[last:] for c in every]]
            size = sum(map(len, held[0][5])) if last else 0  # a key larger than this is gathered whole
    if held:
        yield columns(held)


def covered(n: int, spans: list[dict] | None, width: int) -> np.ndarray:
    """Which of n elements lie in a window of `width` that starts in a span; what reaches beyond the end is cut off."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        a, b = min(s["start"], n), min(s["start"] + s["n"] - 1 + width, n)
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:n]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, packed, spans, *carry) of every row of docs; spans is null where nothing repeats."""
    return _pack(docs, carry).join(spans.withColumnRenamed("doc_id", "id"), "id", "left").select("doc_id", "packed", "spans", *carry)
