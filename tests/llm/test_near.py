import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_copies, near_vectors
from tidemark.llm.components import components


def grouped(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_counts(text):
    w = (text or "").split()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def test_near_copies_against_brute_force(documents, corpus):
    sets = {r[0]: shingle_counts(r[1]) for r in corpus}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    want = grouped(sets, links)
    got = near_copies.near_copies(documents.withColumn("band", F.lit(1)).withColumn("a", F.lit(1))).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got) and len(got) == len(corpus)


def test_large_families_are_cut(spark, monkeypatch):
    """A family of many chunks gives what brute force does."""
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    draw = random.Random(2)
    base = [f"b{k}" for k in range(160)]
    rows = []
    for k in range(40):
        words = base[: draw.choice((100, 130, 160))]
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"x{draw.random()}"
        rows.append((k, " ".join(words)))
    sets = {k: shingle_counts(t) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == grouped(sets, links)
    assert 1 < len({r["component_id"] for r in got}) < 30


def test_a_group_of_near_copies_costs_its_size(spark, monkeypatch):
    """Leaders take a large group: texts are sent a few times each, however many chunks the group has."""
    monkeypatch.setattr(near_copies, "CHUNK", 10)
    sent = []
    for name in ("led", "family_links"):
        real = getattr(near_copies, name)
        monkeypatch.setattr(near_copies, name, lambda rows, *a, real=real: (sent.append(rows.count()), real(rows, *a))[1])
    draw = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, 300):
        words = list(base)
        for _ in range(draw.choice((0, 1, 1, 2, 2))):
            words[draw.randrange(200)] = f"x{draw.random()}"
        rows.append((k, " ".join(words)))
    sets = {k: shingle_counts(t) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and similarity(sets[a], sets[b]) >= 0.8]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == grouped(sets, links)
    assert sum(sent) < 6 * len(rows), sent


def test_overlaps():
    texts = [b"a b c d e f g h", b"a b c d e f g x", b"a b c d e a b c d e a b c d e", b"a b c d e a b c d e"]
    doc, value, times, _ = near_copies.shingles(texts)
    sets = [(value[doc == k], times[doc == k]) for k in range(4)]
    got = near_copies.overlaps(sets, np.arange(4), np.arange(1, 4))
    counts = [shingle_counts(t.decode()) for t in texts]
    for i in range(4):
        for j in range(1, 4):
            if i != j:
                assert got[i, j - 1] == sum((counts[i] & counts[j]).values())


def test_near_copies_without_rows(empty, spark):
    assert near_copies.near_copies(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_copies.near_copies(rows).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_signatures_estimate_weighted_similarity():
    texts = [b"a b c d e " * 30 + b"x y z", b"a b c d e " * 20 + b"x y z w"]
    doc, value, times, _ = near_copies.shingles(texts)
    table = near_copies.signatures(doc, value, times, 2, 3000)
    want = similarity(*(shingle_counts(t.decode()) for t in texts))
    assert abs((table[0] == table[1]).mean() - want) < 0.04


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 64))
    rows = []
    for k in range(220):
        v = base[k % 12] + rng.normal(size=64) * (0.02 + 0.02 * (k % 9))
        rows.append((k, [float(x) for x in v], k % 2))
    rows += [(300 + k, rows[0][1], 0) for k in range(20)]
    rows += [(400, None, 0), (401, [0.0] * 64, 0), (402, [float("nan")] * 64, 0), (403, [None] * 64, 0), (404, rows[0][1], None), (405, [], 0), (406, [2 * x for x in rows[0][1]], 0), (407, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("raw", F.lit(1))
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    label = {r[0]: r[2] for r in rows}
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.98]
    n = Counter(x for pair in links for x in pair)
    want = grouped([r[0] for r in rows], links)
    got = near_vectors.near_vectors(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {k: (n[k], want[k]) for k in want}
    assert len(links) > 500
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_single_precision_vectors(spark):
    """Floats as the tables have them, of several lengths, with null and repeated ids; block distances stay below all pairs."""
    rng = np.random.default_rng(8)
    rows = [(k, np.float32(rng.normal(size=64)).tolist(), 0) for k in range(1500)]
    centre = rng.normal(size=(5, 64))
    rows += [(2000 + k, np.float32(centre[k % 5] + 0.09 * rng.normal(size=64)).tolist(), 1) for k in range(300)]
    rows += [(3000 + k, np.float32(rng.normal(size=3) + (5, 0, 0)).tolist(), 1) for k in range(40)]
    rows += [(None, rows[0][1], 0), (7, rows[9][1], 0), (7, rows[7][1], 0), (3500, [float("inf")] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    seen = spark.sparkContext.accumulator(0)
    got = near_vectors.near_vectors(df, distances=seen).collect()
    known = [(i, np.array(v, np.float64), label) for i, v, label in rows if i is not None and np.isfinite(v).all()]
    n, links = Counter(), []
    for a in range(len(known)):
        for b in range(a):
            (i, x, p), (j, y, q) = known[a], known[b]
            if p == q and len(x) == len(y) and x @ y >= 0.98 * np.linalg.norm(x) * np.linalg.norm(y):
                n.update((a, b))
                links.append((i, j))
    want = grouped({i for i, _, _ in known} | {3500}, links)
    assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == want
    assert sorted(r["n_links"] for r in got if r["vec_id"] is not None) == sorted([n[k] for k in range(len(known))] + [0])
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    assert len(links) > 300 and 0 < seen.value < 1500 * 1499 / 2 + 300 * 299
