import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.common import held_out


def test_learns_from_other_folds(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (" ".join(rng.choice(["one", "two", "three", "of", "and"], 60)) + ".") if k % 3 else "BUY!! NOW!! " * 30, k % 3 and 1) for k in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    features = quality.statistics(docs, drop=("text",))
    model = quality.fit(features, labels)
    got = quality.score(features, model).join(labels.where("quality IS NOT NULL AND doc_id IS NOT NULL"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 40
    assert all((r["score"] >= 0.3) == (r["quality"] == 1) for r in got)


def test_scores_are_the_log_density_difference():
    rng = np.random.default_rng(2)
    s = [np.cov(rng.normal(size=(3, 50))) for _ in range(2)]
    classes = []
    for c in range(2):
        lower = np.linalg.cholesky(s[c])
        classes.append((np.log(0.5), np.full(3, float(c)), np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum()))
    x = rng.normal(size=(20, 3))
    log = [-0.5 * (np.linalg.slogdet(s[c])[1] + np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s[c]), x - c)) for c in range(2)]
    want = 1 / (1 + np.exp(log[0] - log[1]))
    assert np.allclose(quality.Discriminant(tuple(classes)).score(x), want)


def test_odd_texts_and_tables(spark, documents, empty):
    features = quality.statistics(documents)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    scores = [r["score"] for r in quality.score(features, quality.fit(features, labels)).collect()]
    assert scores == [0.5] * documents.count()
    only = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id bigint, quality int")
    assert quality.fit(features, only).constant == 1.0
    assert quality.statistics(empty).count() == 0
    model = quality.Discriminant(((-0.7, np.zeros(13), np.eye(13), 0.0), (-0.7, np.ones(13), 2 * np.eye(13), -1.0)))
    both = quality.score_texts(quality.score(features, model, out="apart"), model).collect()
    assert len(both) == documents.count() and all(r["score"] == r["apart"] for r in both) and quality.score_texts(empty, model).count() == 0


def test_fit_against_plain_covariances(spark):
    """Moments summed over tasks and shrunk give what covariances of all rows in one place give; folds, repeats and nulls."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 4)), rng.normal(1.0, 2.0, size=(90, 4)) @ rng.normal(size=(4, 4))])
    rows = [(k, v.tolist(), "kept") for k, v in enumerate(x)]
    features = spark.createDataFrame([*rows, (None, [9.0] * 4, None)], "doc_id bigint, statistics array<double>, score string").repartition(5)
    marks = [(k, int(k >= 150)) for k in range(240)] + [(3, 0), (200, 0), (None, 1), (7, None), (8, 2), (999, 1)]
    model = quality.fit(features.select("doc_id", "statistics"), spark.createDataFrame(marks, "doc_id bigint, quality int"))
    learnt = [(k, c) for k, c in marks if k is not None and k < 240 and c in (0, 1) and zlib.crc32(str(k).encode()) % 5]
    own = [x[[k for k, c in learnt if c == label]] for label in (0, 1)]
    n = np.array([len(o) for o in own])
    plain = [np.cov(o.T, bias=True) for o in own]
    pooled = (n[0] * plain[0] + n[1] * plain[1]) / n.sum()
    log = []
    for c in (0, 1):
        s = (1 - quality.POOLED) * plain[c] + quality.POOLED * pooled
        s = (1 - quality.IDENTITY) * s + quality.IDENTITY * np.trace(s) / 4 * np.eye(4)
        away = x - own[c].mean(axis=0)
        log.append(np.log(n[c] / n.sum()) - 0.5 * (np.linalg.slogdet(s)[1] + np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away)))
    got = {r["doc_id"]: r for r in quality.score(features, model, out="p").collect()}
    assert len(got) == 241 and got[5]["score"] == "kept"
    assert np.allclose([got[k]["p"] for k in range(240)], 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), atol=1e-6)
