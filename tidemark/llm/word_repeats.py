"""Substring dedup of words by recompression.

Rounds name runs of one symbol, then pairs of neighbours, over all documents: a run is named by its symbol and length, a
pair by its two symbols, where a bit of each symbol's name says whether it may open or close a pair. A name is a 64-bit
hash of what it stands for, so that all tasks give equal substrings equal names and Spark need not gather a dictionary.
Each symbol keeps the stretch of words that its forming looked at; a symbol whose stretch lies inside a window is formed in
every document that has this window, so equal windows have equal interior symbols. A window is read from the highest level
that has such a symbol (the smallest name among several): Spark groups these names over all documents, names that one place
alone has are dropped, and a shared symbol reveals the windows around it. They are verified word by word (see repeats).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import release, with_field
from .repeats import covered, repeated_starts, with_spans
from .words import joined, powers, spread, word_hashes, word_spans

WINDOW, ROUNDS = 20, 3
#: Bits of a symbol's number within a piece, words of a piece (each has fewer than four symbols).
_BITS, PIECE = 26, 1 << 23
#: Windows of a part, where an anchor has too many stretches for one task.
PARTS = (8, 1)
_FAR = 1 << 40
_PAIR, _RUN, _TAG = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC3A5C85C97CB3127), 0xB492B66FBE98F273


def _neighbours(low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of each symbol's left and right neighbour; without bounds at a document's edges."""
    left_low, left_high = np.full(len(low), -_FAR), high.copy()
    right_low, right_high = low.copy(), np.full(len(low), _FAR)
    same = doc[1:] == doc[:-1]
    left_low[1:][same], left_high[1:][same] = low[:-1][same], high[:-1][same]
    right_low[:-1][same], right_high[:-1][same] = low[1:][same], high[1:][same]
    return left_low, left_high, right_low, right_high


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols formed from the words `names` of documents that lie one after another: names, levels (0: the words), and
    the stretch [low, high) of words that each symbol depends on; by level, then place."""
    low, high = np.arange(len(names)), np.arange(len(names)) + 1
    out = [(names, np.zeros(len(names), np.int64), low, high)]
    for level in range(1, rounds + 1):
        if not len(names):
            break
        # runs
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(names)))
        end = first + count - 1
        a, b, c, d = _neighbours(low, high, doc)  # a run ends where the next element differs
        low = np.minimum(np.minimum.reduceat(low, first), np.minimum(a[first], c[end]))
        high = np.maximum(np.maximum.reduceat(high, first), np.maximum(b[first], d[end]))
        doc, name = doc[first], names[first]
        run = count > 1
        names = np.where(run, spread(name * _RUN + count.astype(np.uint64)), name)
        formed = [(names[run], low[run], high[run])]
        # pairs
        closes = (spread(names + np.uint64(level)) >> np.uint64(17) & np.uint64(1)).astype(bool)
        opens = np.zeros(len(names), bool)
        opens[:-1] = ~closes[:-1] & closes[1:] & (doc[1:] == doc[:-1])
        taken = np.zeros(len(names), bool)
        taken[1:] = opens[:-1]
        a, b, c, d = _neighbours(low, high, doc)
        # a pair depends on its two symbols; what opens alone, on the next one too; what closes alone, on the one before
        own_low = np.where(closes, np.minimum(low, a), np.minimum(low, c))
        own_high = np.where(closes, np.maximum(high, b), np.maximum(high, d))
        following = np.zeros_like(names)
        following[:-1] = names[1:]
        pair = spread(names * _PAIR + following)
        names = np.where(opens, pair, names)[~taken]
        low, high, doc, paired = own_low[~taken], own_high[~taken], doc[~taken], opens[~taken]
        formed.append((names[paired], low[paired], high[paired]))
        name, lo, hi = (np.concatenate(x) for x in zip(*formed))
        order = np.argsort(lo, kind="stable")
        out.append((name[order], np.full(len(name), level), lo[order], hi[order]))
    return tuple(np.concatenate(x) for x in zip(*out))


def highest(names: np.ndarray, level: np.ndarray, low: np.ndarray, high: np.ndarray, n_words: int) -> np.ndarray:
    """For each word, the number of the symbol of the highest level, then smallest name, whose stretch lies in the WINDOW
    words from there; for words before the last WINDOW - 1 at least. Numbers are packed into the names' low bits, counted
    from the start of a piece, so that the number of words has no bound."""
    order = np.argsort(low, kind="stable")
    place, size, bits = low[order], (high - low)[order], np.uint64(_BITS)
    rank = (ROUNDS - level[order]).astype(np.uint64) << np.uint64(62) | spread(names[order]) >> np.uint64(2)
    out = np.zeros(n_words, np.int64)
    for a in range(0, n_words, PIECE):
        b = min(a + PIECE, n_words)
        first, last = np.searchsorted(place, (a, b + WINDOW))
        value = rank[first:last] >> bits << bits | np.arange(last - first, dtype=np.uint64)
        at, length_of = place[first:last] - a, size[first:last]
        best = np.full(b - a + WINDOW + 1, np.iinfo(np.uint64).max, np.uint64)
        for length in range(1, WINDOW + 1):  # the least value whose stretch lies in `length` words from here
            if length > 1:
                best[:-1] = np.minimum(best[:-1], best[1:])
            own = np.flatnonzero(length_of == length)
            np.minimum.at(best, at[own], value[own])
        out[a:b] = order[np.minimum((best[: b - a] & np.uint64((1 << _BITS) - 1)).astype(np.int64) + first, len(order) - 1)]
    return out


def stretches_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    data, starts = joined([b" ".join(x.split()) for x in texts])
    first, last, at = word_spans(data, starts)
    words = word_hashes(data, first, last)
    n_words = np.diff(at)
    count = np.maximum(n_words - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    if not len(doc):
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty, data, empty, empty
    names, level, low, high = recompress(words, np.repeat(np.arange(len(texts)), n_words))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + at[:-1][doc]
    symbol = highest(names, level, low, high, len(words))[place]
    new = np.ones(len(place), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(place)))
    symbol, d, start = symbol[begin], doc[begin], place[begin]
    sums = _prefix(words)
    tag = spread(_range_hash(sums, start, start + n - 1 + WINDOW) + n.astype(np.uint64))
    # the words that the symbol depends on are in the window too: with them, an anchor's name is rarely met by chance
    key = spread(names[symbol] + level[symbol].astype(np.uint64) + _range_hash(sums, low[symbol], high[symbol]))
    return key, tag, d, start - at[:-1][d], n, low[symbol] - start, data, first[start], last[start + n - 2 + WINDOW] - first[start]


def _prefix(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(spread(words + np.uint64(11)) * powers(_TAG, len(words)), out=sums[1:])
    return sums, powers(pow(_TAG, -1, 1 << 64), len(words) + 1)


def _range_hash(sums: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sums[0][b] - sums[0][a]) * sums[1][a]


def content_of(text: bytes, starts: np.ndarray, ns: np.ndarray) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a : a + n - 1 + WINDOW]) for a, n in zip(starts.tolist(), ns.tolist())]


def compare(keys, docs, starts, ns, anchors, contents) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of the windows that also start earlier among these stretches."""
    data, base = joined(contents)
    first, last, at = word_spans(data, base)
    sums = _prefix(word_hashes(data, first, last))
    row = np.repeat(np.arange(len(ns)), ns)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(ns) - ns, ns)
    place = at[row] + offset
    h = _range_hash(sums, place, place + WINDOW)
    rank = np.empty(len(ns), np.int64)
    rank[np.lexsort((starts, docs))] = np.arange(len(ns))
    order = np.lexsort((offset, rank[row], h, keys[row]))
    key, h, row, offset, place = keys[row][order], h[order], row[order], offset[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = np.flatnonzero(~new & ((docs[row] != docs[row[head]]) | (starts[row] + offset != (starts[row] + offset)[head])))
    raw = data.tobytes()
    a, b = first[place], last[place + WINDOW - 1]
    other: dict[int, set[bytes]] = {}
    good = []
    for k, a1, b1, a0, b0, g in zip(again.tolist(), a[again].tolist(), b[again].tolist(), a[head[again]].tolist(), b[head[again]].tolist(), head[again].tolist()):
        window = raw[a1:b1]
        if window == raw[a0:b0]:
            good.append(k)
        elif window in other.setdefault(g, set()):  # a collision: told apart by the words
            good.append(k)
        else:
            other[g].add(window)
    return row[good], offset[good]


def cut_repeats(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each row of (doc_id, text): kept has the words that no window of
    20 words covers which also starts earlier (smaller doc_id, or earlier in the same document), joined by one space.

    Null texts have no words; texts of fewer than 20 words lose nothing. A doc_id stands for one text: repeated equal rows
    are one document and all get its result. Rows without an id come before all others, in an order of their texts' hashes;
    equal ones are one document. An empty table gives no rows; other columns are ignored, but those in `carry` stay.
    """
    rows = with_spans(docs, repeated_starts(docs, stretches_of, content_of, compare, PARTS), carry)

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part = batch.slice(at, 300)
                out: list[list] = [[], [], [], []]
                for data, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = unpack(data).split()
                    n = len(words)
                    if spans:
                        gone = covered(n, spans, WINDOW)
                        words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    kept = b" ".join(words)
                    for o, v in zip(out, (n, n - len(words), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest())):
                        o.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(3 + k) for k in range(len(carry))), part.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], names=[*carry, "doc_id", "n_words", "n_removed", "kept", "kept_sha256"])
        release()

    schema = with_field(docs.select(*carry), ("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string"), ("kept_sha256", "string"))
    out = rows.mapInArrow(cut, schema)
    return out.select("doc_id", *[c for c in out.columns if c != "doc_id"])
