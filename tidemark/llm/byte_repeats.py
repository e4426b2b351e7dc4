"""Suffix-array dedup of bytes: prefix polynomial hashes, suffixes sorted by hash-compared merging, exact at the end.

Anchors are the smallest 24-byte hashes of each 100-byte window. The suffixes that start at the occurrences of one anchor
are sorted: a merge sort whose comparisons find the common extension of two suffixes by binary search over prefix
polynomial hashes, so that one takes logarithmic time. Neighbours' common extensions cut the sorted suffixes into runs that
agree to the right of the anchor; hashes of what stands to its left tell which windows are equal. Each such pair is
verified byte by byte; so are the stretches that a task leaves out of the sort because it has them already (see repeats).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import release, with_field
from .repeats import covered, repeated_starts, with_spans
from .words import joined, powers, spread

WIDTH, GRAM, _BITS = 100, 24, 22
#: Windows of a part, where an anchor has too many stretches for one task.
PARTS = (32, 8, 1)
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_RANDOM = np.random.default_rng(7).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class PrefixHash:
    """Polynomial hashes mod 2^64 of all prefixes of some bytes; of(a, b) hashes bytes a to b in constant time."""

    def __init__(self, data: np.ndarray, base: int = _BASE, table: int = 0):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[table][data] * powers(base, len(data)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), len(data) + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def least_places(gram: np.ndarray, reach: int) -> np.ndarray:
    """Place of the smallest of each `reach` hashes in a row, the leftmost of equal ones. Places are packed into the hashes'
    low bits, counted from the start of a piece of at most 2^22 hashes, so that the number of hashes has no bound."""
    bits, out = np.uint64(_BITS), np.empty(max(len(gram) - reach + 1, 0), np.int64)
    piece = (1 << _BITS) - reach
    for base in range(0, len(out), piece):
        part = gram[base : base + piece + reach - 1]
        least = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64)
        step = 1
        while 2 * step <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < reach:
            least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
        out[base : base + piece] = (least & np.uint64((1 << _BITS) - 1)).astype(np.int64) + base
    return out


def stretches_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    data, starts = joined(texts)
    size = np.diff(np.append(starts, len(data))) - 1
    doc = np.repeat(np.arange(len(texts)), np.maximum(size - WIDTH + 1, 0))
    if not len(doc):
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty, data, empty, empty
    hashes = PrefixHash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = spread(hashes.of(at, at + GRAM))
    smallest = least_places(gram, WIDTH - GRAM + 1)
    count = np.maximum(size - WIDTH + 1, 0)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + starts[doc]
    anchor = smallest[place]
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    begin, d = place[first], doc[first]
    tag = spread(PrefixHash(data, _OTHER, 1).of(begin, begin + n - 1 + WIDTH) + n.astype(np.uint64))
    return gram[anchor[first]], tag, d, begin - starts[d], n, anchor[first] - begin, data, begin, n - 1 + WIDTH


def content_of(text: bytes, starts: np.ndarray, ns: np.ndarray) -> list[bytes]:
    return [text[a : a + n - 1 + WIDTH] for a, n in zip(starts.tolist(), ns.tolist())]


def extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common extension of positions a and b, at most room: binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), room.astype(np.int64)
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        same = hashes.of(a, a + middle) == hashes.of(b, b + middle)
        low = np.where(open_ & same, middle, low)
        high = np.where(open_ & ~same, middle - 1, high)
    return low


def suffix_order(data: np.ndarray, hashes: PrefixHash, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Order of the suffixes data[start:end] (a shorter one before those it starts), by a merge sort from below: in each
    round every suffix finds its rank in the neighbouring run by binary search with hash comparisons, all at once."""
    n = len(start)
    order, size = np.arange(n), 1

    def before(x, y, ties):  # suffix x stands before y; equal ones: ties
        room = np.minimum(end[x] - start[x], end[y] - start[y])
        k = extension(hashes, start[x], start[y], room)
        short = k == room
        lx, ly = end[x] - start[x], end[y] - start[y]
        cx = data[np.minimum(start[x] + k, len(data) - 1)].astype(np.int64)
        cy = data[np.minimum(start[y] + k, len(data) - 1)].astype(np.int64)
        return np.where(short, np.where(lx == ly, ties, lx < ly), cx < cy)

    while size < n:
        at = np.arange(n)
        run = at // size
        left = run % 2 == 0
        low = np.minimum(np.where(left, run + 1, run - 1) * size, n)
        high = np.minimum(low + size, n)
        begin = low.copy()
        while (open_ := low < high).any():
            k = np.flatnonzero(open_)
            middle = (low[k] + high[k]) // 2
            # from a left run: how many of the right one stand before it; from a right run: how many of the left one do, or are equal
            yes = before(order[middle], order[k], ~left[k])
            low[k] = np.where(yes, middle + 1, low[k])
            high[k] = np.where(yes, high[k], middle)
        target = run // 2 * 2 * size + (at - run * size) + (low - begin)
        merged = np.empty(n, np.int64)
        merged[target] = order
        order, size = merged, 2 * size
    return order


def compare(keys, docs, starts, ns, anchors, contents) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the windows that also start earlier among these stretches."""
    data, base = joined(contents)
    hashes = PrefixHash(data)
    anchor, end = base + anchors, base + ns - 1 + WIDTH
    order = suffix_order(data, hashes, anchor, end)
    room = np.minimum((end - anchor)[order[1:]], (end - anchor)[order[:-1]])
    common = np.concatenate([[-1], extension(hashes, anchor[order[1:]], anchor[order[:-1]], room)])
    rank = np.empty(len(order), np.int64)
    rank[np.lexsort((starts, docs))] = np.arange(len(order))
    rows, offsets = [], []
    for left in range(WIDTH - GRAM + 1):  # bytes of the window before its anchor
        run = np.cumsum(common < WIDTH - left)
        has = (anchors[order] >= left) & (anchors[order] - left < ns[order])
        if has.sum() < 2:
            continue
        who, run = order[has], run[has]
        side = hashes.of(anchor[who] - left, anchor[who])
        by = np.lexsort((rank[who], side, run))
        who, run, side = who[by], run[by], side[by]
        new = np.ones(len(who), bool)
        new[1:] = (run[1:] != run[:-1]) | (side[1:] != side[:-1])
        earliest = who[np.flatnonzero(new)[np.cumsum(new) - 1]]
        place = starts + anchors
        again = np.flatnonzero(~new & ((docs[who] != docs[earliest]) | (place[who] != place[earliest])))
        if len(again):
            x, y = anchor[who[again]] - left, anchor[earliest[again]] - left
            good = _equal(data, x, y)
            if not good.all():  # a collision: the whole run is told apart by its bytes
                again, good = _by_bytes(data, anchor[who] - left, run), None
            rows.append(who[again if good is None else again[good]])
            offsets.append(anchors[rows[-1]] - left)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(offsets)


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out, span = np.ones(len(x), bool), np.arange(WIDTH)
    for a in range(0, len(x), 20_000):
        out[a : a + 20_000] = (data[x[a : a + 20_000, None] + span] == data[y[a : a + 20_000, None] + span]).all(axis=1)
    return out


def _by_bytes(data: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Numbers of the windows whose bytes stand earlier in this list."""
    seen: set[bytes] = set()
    again = []
    for k, p in enumerate(at.tolist()):
        content = data[p : p + WIDTH].tobytes()
        if content in seen:
            again.append(k)
        seen.add(content)
    return np.array(again, np.int64)


def cut_repeats(docs: DataFrame, carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of each row of (doc_id, text): kept has the bytes that no
    100-byte string covers which also starts earlier (smaller doc_id, or earlier in the same document).

    Null texts are empty; texts of fewer than 100 bytes lose nothing. A doc_id stands for one text: repeated equal rows are
    one document and all get its result. Rows without an id come before all others, in an order of their texts' hashes;
    equal ones are one document. An empty table gives no rows; other columns are ignored, but those in `carry` stay.
    With as_text, kept is a string, without the parts of characters that the cuts left.
    """
    joined_rows = with_spans(docs, repeated_starts(docs, stretches_of, content_of, compare, PARTS), carry)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                out: list[list] = [[], [], [], [], []]
                for data, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = unpack(data)
                    gone = covered(len(raw), spans, WIDTH)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                    runs = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                    for o, v in zip(out, (len(raw), len(raw) - len(kept), runs, kept.decode("utf-8", "ignore") if as_text else kept, hashlib.sha256(kept).hexdigest())):
                        o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(3 + k) for k in range(len(carry))), part.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], names=[*carry, "doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
        release()

    schema = with_field(docs.select(*carry), ("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept", "string" if as_text else "binary"), ("kept_sha256", "string"))
    out = joined_rows.mapInArrow(cut, schema)
    return out.select("doc_id", *[c for c in out.columns if c != "doc_id"])
