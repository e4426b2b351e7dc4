import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_repeats, repeats, word_repeats


def brute(rows, elements, width, glue):
    seen, out = set(), {}
    for doc_id, text in sorted((r[0], r[1] or "") for r in rows):
        own = elements(text)
        gone = np.zeros(len(own), bool)
        for p in range(len(own) - width + 1):
            window = tuple(own[p : p + width])
            if window in seen:
                gone[p : p + width] = True
            seen.add(window)
        kept = [e for e, g in zip(own, gone) if not g]
        out[doc_id] = (len(own), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(glue(kept)).hexdigest())
    return out


def clashing(df):
    return df.withColumn("key", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("packed", F.lit(2))


def test_bytes_against_brute_force(documents, corpus):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in byte_repeats.cut_repeats(clashing(documents)).collect()}
    assert got == brute(corpus, lambda t: list(t.encode()), 100, bytes)


def test_words_against_brute_force(documents, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in word_repeats.cut_repeats(clashing(documents)).collect()}
    want = brute(corpus, lambda t: t.encode().split(), 20, b" ".join)
    assert got == {k: (a, b, d) for k, (a, b, _, d) in want.items()}


@pytest.mark.parametrize("module", [byte_repeats, word_repeats])
def test_crowded_anchors(spark, empty, monkeypatch, module):
    """A passage with another neighbour in each document: no task compares more than a few stretches of an anchor."""
    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "MANY", 10)
    monkeypatch.setattr(repeats, "PARTS", 200)
    draw = random.Random(6)
    passage = " ".join(f"p{draw.getrandbits(20):x}" for _ in range(45))
    word = lambda n: " ".join(f"{draw.getrandbits(24):x}" for _ in range(n))
    rows = [(k, f"{word(draw.randint(0, 20))} {passage} {word(draw.randint(0, 20))}".strip()) for k in range(120)]
    rows += [(k, rows[k % 60][1]) for k in range(120, 150)] + [(150, passage + " " + passage)]
    original = module.compare

    def counted(keys, docs, starts, ns, anchors, contents):
        _, n = np.unique(keys, return_counts=True)
        places = len({(k, c) for k, c in zip(keys.tolist(), contents)})
        assert places == len(keys) or n.max() <= 60, "a key's equal stretches were not reduced"
        distinct = {}
        for k, c in zip(keys.tolist(), contents):
            distinct.setdefault(k, set()).add(c)
        assert max(map(len, distinct.values())) <= 10, "too many stretches of a key in one task"
        return original(keys, docs, starts, ns, anchors, contents)

    monkeypatch.setattr(module, "compare", counted)
    docs = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], empty.schema).repartition(4)
    size, elements, width, glue = ("n_bytes", lambda t: list(t.encode()), 100, bytes) if module is byte_repeats else ("n_words", lambda t: t.encode().split(), 20, b" ".join)
    got = {r["doc_id"]: (r[size], r["n_removed"], r["kept_sha256"]) for r in module.cut_repeats(docs).collect()}
    assert got == {k: (a, b, d) for k, (a, b, _, d) in brute(rows, elements, width, glue).items()}


@pytest.mark.parametrize("module", [byte_repeats, word_repeats])
def test_empty_and_repeated(spark, empty, module):
    assert module.cut_repeats(empty).count() == 0
    text = " ".join(f"v{k}" for k in range(90))
    rows = [(1, text, "en", "a", 1)] * 2 + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, empty.schema)
    got = module.cut_repeats(docs, carry=("lang",)).collect()
    assert len(got) == 3 and {r["n_removed"] for r in got} == {0}
    assert sorted(r["lang"] or "" for r in got) == ["", "en", "en"]


@pytest.mark.parametrize("module", [byte_repeats, word_repeats])
def test_hashes_only_propose(spark, documents, corpus, monkeypatch, module):
    """With names and digests that collide everywhere, elements decide, in tasks and across them."""
    strong = module.stretches_of

    def weak(texts):
        key, tag, *rest = strong(texts)
        return [key % np.uint64(3), tag & np.uint64(1), *rest]

    monkeypatch.setattr(module, "stretches_of", weak)
    size, elements, width, glue = ("n_bytes", lambda t: list(t.encode()), 100, bytes) if module is byte_repeats else ("n_words", lambda t: t.encode().split(), 20, b" ".join)
    got = {r["doc_id"]: (r[size], r["n_removed"], r["kept_sha256"]) for r in module.cut_repeats(documents).collect()}
    assert got == {k: (a, b, d) for k, (a, b, _, d) in brute(corpus, elements, width, glue).items()}


@pytest.mark.parametrize("module", [byte_repeats, word_repeats])
def test_rows_without_an_id(spark, empty, module):
    """They come before all others; different texts stay apart, equal ones are one document."""
    draw = random.Random(12)
    text = lambda n: " ".join(f"{draw.getrandbits(32):x}" for _ in range(n))
    shared, own = text(60), text(60)
    rows = [(None, f"{text(50)} {own} {text(9)} {own} {shared}"), (None, text(80)), (None, None), (3, f"{text(30)} {shared} {text(30)}"), (-5, own + " " + text(40))]
    rows.append(rows[0])
    docs = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], empty.schema).repartition(3)
    size, elements, width, glue = ("n_bytes", lambda t: list(t.encode()), 100, bytes) if module is byte_repeats else ("n_words", lambda t: t.encode().split(), 20, b" ".join)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r[size], r["n_removed"], r["kept_sha256"]) for r in module.cut_repeats(docs).collect())
    numbered = [(-100 + k, rows[k][1]) for k in range(3)] + rows[3:5]
    by = brute(numbered, elements, width, glue)
    want = [(k >= -50, k if k >= -50 else 0, n, gone, digest) for k, (n, gone, _, digest) in by.items()]
    want.append(next(w for w in want if w[2] == by[-100][0]))
    assert got == sorted(want)


def test_a_very_long_text(spark, empty):
    """20 MB in one text, with a passage that stands at both ends and in another document."""
    draw = random.Random(14)
    passage = " ".join(f"p{draw.getrandbits(32):x}" for _ in range(40))
    big = passage + " " + draw.randbytes(10_000_000).hex(" ", 4) + " " + passage
    docs = spark.createDataFrame([(2, big, None, None, None), (1, "one " + passage + " two", None, None, None)], empty.schema)
    got = {r["doc_id"]: r for r in byte_repeats.cut_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_bytes"] == len(big) and got[2]["n_removed"] in range(2 * len(passage), 2 * len(passage) + 4) and got[2]["n_spans"] == 2
    got = {r["doc_id"]: r for r in word_repeats.cut_repeats(docs).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 80


def test_symbols_do_not_depend_on_pieces(monkeypatch):
    words = np.random.default_rng(5).integers(0, 50, 3000, dtype=np.uint64)
    symbols = word_repeats.recompress(words, np.repeat([0, 1, 2], 1000))
    whole = word_repeats.highest(*symbols, 3000)
    monkeypatch.setattr(word_repeats, "PIECE", 171)
    cut = word_repeats.highest(*symbols, 3000)
    assert (symbols[0][whole[:2980]] == symbols[0][cut[:2980]]).all() and (symbols[1][whole[:2980]] >= 2).mean() > 0.9


def test_text_longer_than_four_mebibytes(spark, empty):
    """Repeats before, on and beyond 2^22 bytes; what doc 2 has stands in doc 1 beyond them only."""
    draw = random.Random(4)
    noise = lambda n: draw.randbytes(n // 2).hex()
    p, q, edge = noise(300), noise(300), 1 << 22
    a, b, c = noise(1000), noise(edge - 1000 - 300 - 2 - 150), noise(100_000)
    big = a + p + "<" + b + ">" + p + "[" + c + "]" + p + "{" + noise(500) + "}" + q + "|" + noise(400)
    docs = spark.createDataFrame([(1, big, None, None, None), (2, noise(600) + "_" + q + "~" + noise(300), None, None, None)], empty.schema)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in byte_repeats.cut_repeats(docs).collect()}
    assert got == {1: (600, 2), 2: (300, 1)}


def test_places_do_not_depend_on_pieces(monkeypatch):
    gram = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1)
    gram[1000:1300] = gram[1000]
    whole = byte_repeats.least_places(gram, 77)
    assert whole.tolist() == [k + int(np.argmin(gram[k : k + 77] >> np.uint64(22))) for k in range(5000 - 76)]
    odd = byte_repeats.least_places(np.concatenate([np.zeros((1 << 22) + 5, np.uint64) + np.uint64(1 << 62), gram]), 77)
    assert (odd[-len(whole) :] - ((1 << 22) + 5)).tolist() == whole.tolist()


def test_suffix_order():
    draw = random.Random(3)
    data = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(2000)), np.uint8)
    start = np.array(draw.sample(range(1900), 300))
    end = np.minimum(start + np.array([draw.randint(1, 60) for _ in start]), 2000)
    order = byte_repeats.suffix_order(data, byte_repeats.PrefixHash(data), start, end)
    ranked = [data[a:b].tobytes() for a, b in zip(start[order], end[order])]
    assert ranked == sorted(ranked)


def test_collisions_are_told_apart(monkeypatch, documents, corpus):
    """With a left hash that is always the same, bytes decide."""
    order = byte_repeats.PrefixHash.of
    text = bytes(range(33, 120))
    contents = [b"L" * 30 + text + b"R" * 30, b"M" * 30 + text + b"R" * 30, b"L" * 30 + text + b"R" * 30]
    n = len(contents[0]) - 99
    args = [np.zeros(3, np.int64), np.arange(3), np.zeros(3, np.int64), np.full(3, n), np.full(3, 47), contents]

    def weak(self, a, b):
        return np.zeros(len(a), np.uint64) if len(a) and (b == 47 + np.array([0, 148, 296])[np.clip(b // 148, 0, 2)]).all() else order(self, a, b)

    want = {(2, k) for k in range(n)} | {(1, k) for k in range(30, n)}
    got = lambda: set(zip(*(x.tolist() for x in byte_repeats.compare(*args))))
    assert got() == want
    monkeypatch.setattr(byte_repeats.PrefixHash, "of", weak)
    assert got() == want


def test_equal_substrings_share_symbols():
    draw = random.Random(5)
    inside = [draw.getrandbits(60) for _ in range(40)]
    docs = [[draw.getrandbits(60) for _ in range(30)] + inside + [draw.getrandbits(60) for _ in range(30)] for _ in range(2)]
    words = np.array(docs[0] + docs[1], np.uint64)
    names, level, low, high = word_repeats.recompress(words, np.repeat([0, 1], 100))
    own = [{(n, l, a - 100 * d - 30) for n, l, a, b in zip(names, level, low, high) if 100 * d + 30 <= a and b <= 100 * d + 70} for d in (0, 1)]
    assert own[0] == own[1] and max(l for _, l, _ in own[0]) == word_repeats.ROUNDS
