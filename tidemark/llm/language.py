"""Language identification by a linear-chain conditional random field over the words of a text.

States are the languages. A word's emission is the sum of weights of its character n-grams inside word borders (those that
touch a border are its affixes) and of its entry in a learnt lexicon; transitions are learnt too. Forward-backward gives
each word's posterior, so that a code-switched text is labelled word by word; a document's language is the one with the
largest mean posterior. Training maximises the likelihood of sequences that join stretches of different documents, so
that switches are seen. Prediction reads whole texts; only training uses a bounded sample, slices drawn from whole texts.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, texts, with_columns, with_field

WORD = re.compile(r"[^\W\d_]+")
#: Characters that WORD takes although they are numbers and no letters, such as fractions.
_NUMERALS = frozenset(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
UNKNOWN = "und"
#: Training sample: about so many slices of text for each language, and the characters of a slice.
SAMPLE_SLICES, SLICE_CHARS = 300, 1000
BUCKETS, ORDERS = 1 << 17, (2, 3, 4)
#: Words that at least so many sampled documents hold enter the lexicon.
LEXICON_LEAST = 3
ROUNDS, RATE, DECAY = 40, 0.25, 1e-5
#: Words whose emissions a worker keeps, and bytes of text that a task labels at a time.
KEPT_WORDS, BLOCK = 400_000, 6_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in small letters."""
    low = text.lower()
    if not low.isascii() and not _NUMERALS.isdisjoint(low):
        low = low.translate(dict.fromkeys(map(ord, _NUMERALS.intersection(low)), " "))
    return WORD.findall(low)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_features(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each order at each character (0 where none starts), the words' starts in these arrays,
    and a hash of each whole word."""
    code = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    left = np.repeat(starts + size, size) - np.arange(len(code))  # characters from here to the word's end
    grams, h = [], _spread(code + np.uint64(1))
    for order in range(2, max(ORDERS) + 1):
        following = np.zeros_like(code)
        following[: len(code) - order + 1] = code[order - 1 :]
        h = _spread(h * np.uint64(0x100000001B3) + following)
        if order in ORDERS:
            grams.append(np.where(left >= order, (h % np.uint64(BUCKETS - 1)).astype(np.int64) + 1, 0))
    place = (np.arange(len(code)) - np.repeat(starts, size)).astype(np.uint64)
    whole = np.add.reduceat(_spread(code * np.uint64(0x10001) + place), starts) if len(words) else np.zeros(0, np.uint64)
    return grams, starts, whole


@dataclass
class ChainField:
    """Languages, n-gram weights (bucket 0 is none), lexicon hashes and weights (the last is none), transitions."""

    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    transitions: np.ndarray

    def lexicon_rows(self, whole: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.lexicon, whole)
        found = at < len(self.lexicon)
        found[found] = self.lexicon[at[found]] == whole[found]
        return np.where(found, at, len(self.lexicon))

    def emissions(self, words: list[str]) -> np.ndarray:
        grams, starts, whole = word_features(words)
        total = self.entries[self.lexicon_rows(whole)].astype(np.float32)
        for g in grams:
            total += np.add.reduceat(self.grams[g], starts, axis=0)
        return total


def posteriors(emission: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many sequences that lie one after another in `emission`: each word's posterior, and the
    scaled forward and backward tables. All sequences step together, the longest first."""
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    step = np.exp(transitions).astype(e.dtype)
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0] if len(size) else 0), side="right")
    forward, backward = np.empty_like(e), np.ones_like(e)
    now = None
    for t, k in enumerate(active.tolist()):
        at = starts[:k] + t
        now = e[at] if now is None else (now[:k] @ step) * e[at]
        now /= now.sum(axis=1, keepdims=True)
        forward[at] = now
    for t in range(len(active) - 2, -1, -1):
        k = int(active[t + 1])
        at = starts[:k] + t
        following = (e[at + 1] * backward[at + 1]) @ step.T
        following /= following.sum(axis=1, keepdims=True)
        backward[at] = following
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    return p, forward, backward


def sample(docs: DataFrame, slices_each: int = SAMPLE_SLICES, chars: int = SLICE_CHARS) -> list[tuple[str, str]]:
    """(lang, slice) of about `slices_each` slices of `chars` characters for each language, from labelled documents
    outside fold 0. Every slice of every such whole text is drawn with the same chance, by a hash of the id and the slice's
    number: the same slices at every run, as many for a corpus of any size. Words cut by a slice's edges are left out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    many = F.greatest(F.ceil(F.length("text") / chars), F.lit(1)).cast("int")
    known = known.select("doc_id", "lang", "text", many.alias("many"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("many").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, slices_each / n)))])
    draw = lambda k: F.pmod(F.xxhash64(F.lit(17), F.col("doc_id"), k), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.filter(F.sequence(F.lit(0), F.col("many") - 1), lambda k: draw(k) < share[F.col("lang")])
    # a character more on each side tells whether a word is cut there
    cut = F.transform(chosen, lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), F.greatest(k * chars, F.lit(1)), F.when(k == 0, chars + 1).otherwise(chars + 2)).alias("part")))
    rows = known.select("doc_id", "lang", cut.alias("cut")).where(F.size("cut") > 0).select("doc_id", "lang", F.explode("cut").alias("cut")).select("doc_id", "lang", "cut.*").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["k"], r["part"]))
    return [(r["lang"], _whole_words(r["part"], r["k"] > 0, len(r["part"]) > chars + (r["k"] > 0))) for r in rows]


def _whole_words(part: str, more_before: bool, more_after: bool) -> str:
    """A slice, with a character more on the sides where its text goes on, without the words cut at its edges."""
    found = [m.span() for m in WORD.finditer(part)]
    low = 1 if more_before else 0
    high = len(part) - 1 if more_after else len(part)
    if found and found[0][0] < low:
        low = found[0][1]
    if found and found[-1][1] > high:
        high = found[-1][0]
    return part[low:high]


@dataclass
class Training:
    """Sequences of words that lie one after another: each word's place in a vocabulary and its language, the sequences'
    lengths, and the vocabulary's n-gram buckets, starts and lexicon rows."""

    word: np.ndarray
    label: np.ndarray
    lengths: np.ndarray
    grams: list[np.ndarray]
    starts: np.ndarray
    rows: np.ndarray

    def emissions(self, model: ChainField) -> np.ndarray:
        total = model.entries[self.rows].astype(np.float64)
        for g in self.grams:
            total += np.add.reduceat(model.grams[g], self.starts, axis=0)
        return total[self.word]

    def slopes(self, model: ChainField) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slope of the log likelihood of all sequences by the n-gram weights, the entries and the transitions: what is
        there less what the model expects."""
        many, vocabulary = len(model.languages), len(self.rows)
        inside = np.ones(len(self.word), bool)
        inside[np.cumsum(self.lengths) - 1] = False
        pairs = np.flatnonzero(inside)  # words that have a next one
        e = self.emissions(model)
        p, forward, backward = posteriors(e, model.transitions, self.lengths)
        scaled = np.exp(e - e.max(axis=1, keepdims=True))
        joint = forward[pairs][:, :, None] * np.exp(model.transitions)[None] * (scaled * backward)[pairs + 1][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        change = np.zeros((many, many))
        np.add.at(change, (self.label[pairs], self.label[pairs + 1]), 1.0)
        change -= joint.sum(axis=0)
        error = -p
        error[np.arange(len(self.word)), self.label] += 1
        by_word = np.stack([np.bincount(self.word, error[:, c], vocabulary) for c in range(many)], axis=1)
        owner = np.repeat(np.arange(vocabulary), np.diff(np.append(self.starts, len(self.grams[0]))))
        slope = np.zeros(model.grams.shape)
        for g in self.grams:
            for c in range(many):
                slope[:, c] += np.bincount(g, by_word[owner, c], len(slope))
        slope[0] = 0
        entry = np.stack([np.bincount(self.rows, by_word[:, c], len(model.entries)) for c in range(many)], axis=1)
        entry[-1] = 0
        return slope, entry, change


def prepared(rows: list[tuple[str, str]], draw: np.random.Generator) -> tuple[ChainField, Training | None]:
    """An untrained field for the sample and its sequences: three stretches of different slices, in a drawn order."""
    languages = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(languages)}
    stretches: list[tuple[int, list[str]]] = []
    holders: dict[str, set[int]] = {}
    for n, (lang, text) in enumerate(rows):
        found = words_of(text)
        if not found:
            continue
        for w in found:
            holders.setdefault(w, set()).add(n)
        at = 0
        while at < len(found):
            size = int(draw.integers(4, 40))
            stretches.append((number[lang], found[at : at + size]))
            at += size
    if not stretches:
        return ChainField([], np.zeros((1, 0), np.float32), np.zeros(0, np.uint64), np.zeros((1, 0), np.float32), np.zeros((0, 0))), None
    vocabulary = sorted(holders)
    index = {w: k for k, w in enumerate(vocabulary)}
    draw.shuffle(stretches)
    word, label, lengths = [], [], []
    for k in range(0, len(stretches), 3):  # three stretches make a sequence
        group = stretches[k : k + 3]
        lengths.append(sum(len(s) for _, s in group))
        for lang, s in group:
            word += [index[w] for w in s]
            label += [lang] * len(s)
    many = len(languages)
    grams, starts, whole = word_features(vocabulary)
    lexicon = np.unique(whole[[k for k, w in enumerate(vocabulary) if len(holders[w]) >= LEXICON_LEAST]])
    model = ChainField(languages, np.zeros((BUCKETS, many), np.float32), lexicon, np.zeros((len(lexicon) + 1, many), np.float32), np.eye(many))
    return model, Training(np.array(word), np.array(label), np.array(lengths), grams, starts, model.lexicon_rows(whole))


def fit(rows: list[tuple[str, str]], seed: int = 5) -> ChainField:
    """Learns the field from the sample by adaptive gradient steps on the likelihood of code-switched sequences.

    Texts without letters teach nothing; with no usable row there are no languages and every prediction is `und`.
    """
    model, training = prepared(rows, np.random.default_rng(seed))
    if training is None:
        return model
    weights = (model.grams, model.entries, model.transitions)
    squares = [np.full(x.shape, 1e-6) for x in weights]
    for _ in range(ROUNDS):
        for weight, own, square in zip(weights, training.slopes(model), squares):
            own = own / len(training.word) - DECAY * weight
            square += own * own
            weight += (RATE * own / np.sqrt(square)).astype(weight.dtype)
    return model


def predict(df: DataFrame, model: ChainField, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with lang_pred and score (the mean posterior of that language over the words, 0 to 1).

    `und` with score 0 where text is null or has no letter, or where nothing was learnt. Ties go to the first language in
    order. Rows are independent; an empty table stays empty.
    """
    col = df.columns.index(text)

    def run(batches):
        known: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)), np.float32)
        for batch in batches:
            column = batch.column(col)
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset :]) if len(column) else np.zeros(0)
            for a, b in slices(sizes, BLOCK):
                part = batch.slice(a, b - a)
                found = [words_of(x) for x in texts(part.column(col))]
                if len(known) > KEPT_WORDS:
                    known, table = {}, table[:0]
                new = list(set().union(*found) - known.keys())
                if new and model.languages:
                    for w in new:
                        known[w] = len(known)
                    table = np.concatenate([table] + [model.emissions(new[k : k + 50_000]) for k in range(0, len(new), 50_000)])
                lengths = np.array([len(x) for x in found], np.int64)
                pred, score = [UNKNOWN] * len(found), np.zeros(len(found))
                if lengths.sum() and model.languages:
                    number = known.__getitem__
                    at = np.fromiter((number(w) for x in found for w in x), np.int64, int(lengths.sum()))
                    p, _, _ = posteriors(table[at], model.transitions, lengths)
                    full = np.flatnonzero(lengths)
                    mean = np.add.reduceat(p, (np.cumsum(lengths) - lengths)[full], axis=0) / lengths[full, None]
                    best = mean.argmax(axis=1)
                    score[full] = np.clip(mean[np.arange(len(full)), best], 0, 1)
                    for k, c in zip(full.tolist(), best.tolist()):
                        pred[k] = model.languages[c]
                yield with_columns(part, {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}, drop)

    return df.mapInArrow(run, with_field(df, ("lang_pred", "string"), ("score", "double"), drop=drop))
