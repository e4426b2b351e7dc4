"""SentencePiece encoding and decoding by a table of each prefix's last token.

Method. In byte-pair encoding the encoding of a prefix of a word ends in one certain token, and a sequence of tokens is
the encoding of its text exactly if every two neighbours are compatible: encoding both texts together gives back the two
tokens. So the table of a word holds, for each prefix, the only token that an automaton finds ending there and that is
compatible with the table's entry where it starts. The ids are recovered backwards from the whole word's entry. Words
never share a merge (no piece has the space mark inside), so each distinct word of a batch is encoded once.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import release, slices, texts, with_columns, with_field

SPACE = "▁"
#: Distinct words whose ids a Python worker keeps; beyond it the table starts anew, so a worker's memory is bounded.
KEPT_WORDS = 250_000
#: Bytes of text that a task encodes at a time.
BLOCK = 1_500_000


class Words(dict):
    """Numbers of words; a new word is encoded as it is first looked up."""

    def __init__(self, place: Callable[[str | tuple[str]], int]):
        super().__init__()
        self.place = place

    def __missing__(self, key: str | tuple[str]) -> int:
        return self.place(key)


class PieceTable:
    """The merge table of a BPE model with byte fallback, as read through the library's vocabulary calls."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = [i for i in range(size) if model.is_byte(i)]
        self.eos, self.bos, self.unk = model.eos_id(), model.bos_id(), model.unk_id()
        special = {*self.bytes, *(i for i in range(size) if model.is_control(i) or model.is_unknown(i))}
        self.special = special
        self.ids = {self.pieces[i]: i for i in range(size) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has the space mark inside: words can't be encoded apart")
        if any(" " in p or "\n" in p for p in self.ids):
            raise ValueError("a piece has a space or line end inside")
        self.chars = {p for p in self.ids if len(p) == 1}
        self.rank = [-1] * size
        self.left, self.right = [0] * size, [0] * size
        self.pair: dict[tuple[int, int], int] = {}
        self._learn(sorted((i for p, i in self.ids.items() if len(p) > 1 and p.strip(SPACE)), key=lambda i: (-model.get_score(i), i)))
        self.known: dict[int, bool] = {}
        self._start()

    def _learn(self, merged: list[int]) -> None:
        """Each piece's last merge, and the automaton of the pieces that merging can reach."""
        self.automaton = ahocorasick.Automaton()
        for p in self.chars:
            self.automaton.add_word(p, (self.ids[p], 1))
        rank = {}
        for r, i in enumerate(merged):
            parts = self._merge(self.pieces[i], rank)
            if len(parts) == 2:
                a, b = self.ids[parts[0]], self.ids[parts[1]]
                self.left[i], self.right[i], self.rank[i], self.pair[a, b] = a, b, r, i
                self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
            rank[self.pieces[i]] = r
        self.automaton.make_automaton()

    @staticmethod
    def _merge(text: str, rank: dict[str, int]) -> list[str]:
        """Plain merging of a short text with the pieces in rank: the best pair first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((rank.get(a + b, len(rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == len(rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _start(self) -> None:
        self.words = Words(self.place)
        self.flat, self.starts = [], [0]

    def forget(self) -> None:
        """Drops the words met so far; a worker that is idle holds the tables alone."""
        self._start()
        self.known = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of a and b together ends in a, b: undoes merges from the last to the first and
        looks for a pair across the border that would have come before the merge undone."""
        key = a * len(self.pieces) + b
        if (got := self.known.get(key)) is not None:
            return got
        rank, limit, good = self.rank, len(self.pieces), True
        while True:
            across = self.pair.get((a, b))
            if across is not None and rank[across] < limit:
                good = False
                break
            if rank[a] > rank[b]:
                limit, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.left[b]
            else:
                break
        self.known[key] = good
        return good

    def _known_chars(self, text: str) -> list[int]:
        """Ids of a text of characters that are pieces: fills the prefix table, then reads it backwards."""
        size = len(text)
        last, width = [-1] * (size + 1), [0] * (size + 1)
        known, many = self.known, len(self.pieces)
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                start = end - n
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    good = known.get(before * many + token)
                    if good is None:
                        good = self.compatible(before, token)
                    if not good:
                        continue
                last[end], width[end] = token, n
        ids = []
        while size:
            ids.append(last[size])
            size -= width[size]
        ids.reverse()
        return ids

    def _marks(self, n: int) -> list[int]:
        """Ids of n space marks: their pieces have one and the same score, so the leftmost pair that is a piece merges."""
        stack: list[int] = []
        for _ in range(n):
            stack.append(1)
            while len(stack) > 1 and SPACE * (stack[-2] + stack[-1]) in self.ids:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.ids.get(SPACE * k, self.unk) for k in stack]

    def piece_ids(self, text: str) -> list[int]:
        """Ids of a text with space marks for spaces and no mark before it but its own."""
        if self.chars.issuperset(text) and SPACE + SPACE not in text:
            return self._known_chars(text)
        if SPACE + SPACE in text:  # marks merge with each other after all else
            head = len(text) - len(text.lstrip(SPACE))
            if head == len(text):
                return self._marks(head)
            if SPACE + SPACE not in text[head:] and head:
                tail = self.piece_ids(SPACE + text[head:])
                return self._marks(head) + tail[1:] if tail[0] == self.ids.get(SPACE) else self._marks(head - 1) + tail
            return [i for part in _words(text) for i in self.piece_ids(part)]
        ids: list[int] = []
        run = 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if k > run:
                    ids += self._known_chars(text[run:k])
                ids += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]
                run = k + 1
        return ids + self._known_chars(text[run:]) if run < len(text) else ids

    def word_keys(self, text: str) -> list[str] | list[tuple[str]]:
        """The text as keys of words: a key is a word after its space, or starts with a line end and has no space before.
        Where marks can't be told from spaces so, keys are the words with their marks, in tuples of their own."""
        if not text:
            return []
        keys = text.replace("\n", " \n").split(" ")
        if keys[0] == "" and text[0] == "\n":
            keys[0] = SPACE  # only the mark that every text gets
        if "" in keys or SPACE in text:
            return [(w,) for w in _words((SPACE + text).replace(" ", SPACE))]
        return keys

    def place(self, key: str | tuple[str]) -> int:
        """The number of a new word, after encoding it."""
        n = len(self.words)
        if isinstance(key, tuple):
            text = key[0]
        else:
            text = key if key[0] == "\n" or key == SPACE else SPACE + key
        self.words[key] = n
        self.flat += self.piece_ids(text)
        self.starts.append(len(self.flat))
        return n

    def encode_batch(self, many: list[str], bos: bool, eos: bool) -> pa.ListArray:
        if len(self.words) > KEPT_WORDS:
            self.forget()
        numbers, counts, number_of = array("i"), [], self.words.__getitem__
        for text in many:
            keys = self.word_keys(text)
            numbers.extend(map(number_of, keys))
            counts.append(len(keys))
        number, starts = np.frombuffer(numbers, np.int32), np.array(self.starts, np.int64)
        flat = np.array(self.flat, np.int32)
        length = starts[number + 1] - starts[number] if len(number) else np.zeros(0, np.int64)
        ends = np.cumsum(length)
        ids = flat[np.repeat(starts[number] - (ends - length), length) + np.arange(ends[-1])] if len(number) else np.zeros(0, np.int32)
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[at]
        if bos or eos:
            extra = bos + eos
            out = np.empty(len(ids) + extra * len(many), np.int32)
            shift = offsets + extra * np.arange(len(many) + 1)
            body = np.ones(len(out), bool)
            if bos:
                body[shift[:-1]] = False
            if eos:
                body[shift[1:] - 1] = False
            out[body] = ids
            if bos:
                out[shift[:-1]] = self.bos
            if eos:
                out[shift[1:] - 1] = self.eos
            ids, offsets = out, shift
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    @cached_property
    def surface(self) -> pa.Array:
        """Each id's bytes inside a decoded text; then each id's bytes where a text starts, without the mark that encoding set."""
        low = {i: bytes([k]) for k, i in enumerate(self.bytes)}
        inside = [
            low[i] if i in low else b" \xe2\x81\x87 " if i == self.unk else b"" if i in self.special else p.replace(SPACE, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        first = [x[1:] if p.startswith(SPACE) else x for p, x in zip(self.pieces, inside)]
        return pa.array(inside + first, pa.large_binary())

    def decode_batch(self, column: pa.Array) -> list[str]:
        ids = column.values.to_numpy(zero_copy_only=False).astype(np.int32)
        offsets = column.offsets.to_numpy().astype(np.int64)
        silent = np.isin(ids, [i for i in self.special if i != self.unk and i not in self.bytes])
        sounding = np.concatenate([np.flatnonzero(~silent), [len(ids)]])
        first = sounding[np.searchsorted(sounding, offsets[:-1])]  # control ids before a text leave no trace
        ids[first[first < offsets[1:]]] += len(self.pieces)
        raw = self.surface.take(pa.array(ids))
        ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1)
        cuts = np.union1d(offsets, np.flatnonzero(silent))  # bytes on the two sides of a control id make no character
        at = ends[cuts].tolist()
        data = memoryview(raw.buffers()[2] or b"")
        parts = []
        for a, b in zip(at, at[1:]):
            try:
                parts.append(str(data[a:b], "utf-8"))
            except UnicodeDecodeError:
                parts.append(_byte_wise(bytes(data[a:b])))
        bounds = np.searchsorted(cuts, offsets).tolist()
        return ["".join(parts[a:b]) for a, b in zip(bounds, bounds[1:])]


def _byte_wise(raw: bytes) -> str:
    """UTF-8 where each byte that is no part of a character becomes one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _words(marked: str) -> list[str]:
    """A text with space marks, cut before each run of marks and each line end."""
    out, start, before = [], 0, ""
    for k, c in enumerate(marked):
        if k and (c == "\n" or c == SPACE and before != SPACE):
            out.append(marked[start:k])
            start = k
        before = c
    return out + [marked[start:]]


@lru_cache(maxsize=2)
def piece_table(model_path: str) -> PieceTable:
    """One table for each worker and model."""
    return PieceTable(model_path)


def encode(
    df: DataFrame, model_path: str, text: str = "text", out: str = "ids", bos: bool = False, eos: bool = True, decoded: str | None = None, drop: tuple[str, ...] = ()
) -> DataFrame:
    """df with `out`, an array of the ids that the sentencepiece library gives for `text` with this model; and, where
    `decoded` names a column, the text that these ids decode to.

    Null and empty texts have no ids but bos and eos. A column that is called `out` is replaced; others stay, but those
    in `drop`. Rows are independent: repeated rows and any order give the same ids, and an empty table stays empty.
    """
    col = df.columns.index(text)

    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            many = texts(batch.column(col))
            for a, b in slices(np.fromiter(map(len, many), np.int64, len(many)), BLOCK):
                new = {out: table.encode_batch(many[a:b], bos, eos)}
                if decoded:
                    new[decoded] = pa.array(table.decode_batch(new[out]), pa.string())
                yield with_columns(batch.slice(a, b - a), new, drop)
        table.forget()
        release()

    return df.mapInArrow(run, with_field(df, (out, "array<int>"), *[(decoded, "string")] * bool(decoded), drop=drop))


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with `out`, the text that the library's decode gives for the ids; null or no ids give an empty text."""
    col = df.columns.index(ids)

    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                column = part.column(col)
                lists = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32())) if column.null_count else column
                yield with_columns(part, {out: pa.array(table.decode_batch(lists), pa.string())}, drop)

    return df.mapInArrow(run, with_field(df, (out, "string"), drop=drop))
