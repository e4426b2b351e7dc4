"""The registered queries themselves: columns, SQL, folds, and brute force on the smallest tables."""

import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import fingerprint, mixing, queries

from .test_near import grouped, shingle_counts, similarity
from .test_repeats import brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


def run(spark, name):
    return queries.QUERIES[name](spark, str(DATA)).toPandas()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(DATA / "documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return list(zip(docs.doc_id.tolist(), docs.text.tolist()))


def sql(name, text=None):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con.execute(text or queries.ORACLE_SQL[name]).df()


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    of = lambda f: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert of(got) == of(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(run(spark, name), sql(name))


def test_mixing_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 10)
    got = run(spark, "op4_mixing")
    assert got.source_size.max() > 6 << 10
    same(got, sql("op4_mixing", queries.ORACLE_SQL["op4_mixing"].replace("1048576", "1024")))


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def test_fingerprints(spark, rows):
    got = run(spark, "op1_fingerprint").set_index("doc_id")
    rows = sorted(rows)
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got.loc[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.digest(fingerprint.canonical(text)) and r.edited_fingerprint == fingerprint.digest(fingerprint.canonical(edited))


def test_quality(spark):
    got, labels = run(spark, "op2_quality"), pd.read_parquet(DATA / "labels.parquet").set_index("doc_id").quality
    assert got.held_out.tolist() == [fold(i) == 0 for i in got.doc_id]
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    own = got[got.held_out & got.doc_id.isin(labels.index)]
    assert len(own) >= 10 and (own.predicted == labels[own.doc_id].to_numpy()).mean() > 0.9


def test_repeats(spark, rows):
    got = run(spark, "op3_byte_repeats")
    want = brute(rows, lambda t: list(t.encode()), 100, bytes)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()} == want
    got = run(spark, "op7_word_repeats")
    want = brute(rows, lambda t: t.encode().split(), 20, b" ".join)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.itertuples()} == {k: (a, b, d) for k, (a, b, _, d) in want.items()}


def test_near_vectors(spark):
    got = run(spark, "op5_near_vectors").set_index("vec_id")
    table = pd.read_parquet(DATA / "embeddings.parquet")
    vectors = np.stack(table.embedding.map(lambda v: np.asarray(v, np.float64)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (vectors @ vectors.T >= 0.98) & (table.label.to_numpy()[:, None] == table.label.to_numpy()[None])
    np.fill_diagonal(near, False)
    ids = table.vec_id.tolist()
    want = grouped(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    assert got.n_links.to_dict() == dict(zip(ids, near.sum(axis=1).tolist()))
    assert got.component_id.to_dict() == want and (got.kept == (got.component_id == got.index)).all()


def test_near_copies(spark, rows):
    got = run(spark, "op6_near_copies").set_index("doc_id")
    sets = {i: shingle_counts(t) for i, t in rows}
    ids = sorted(sets)
    want = grouped(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similarity(sets[a], sets[b]) >= 0.8])
    assert got.component_id.to_dict() == want and (got.kept == (got.component_id == got.index)).all()


def test_piece_codec(spark, rows):
    got = run(spark, "op9_piece_codec").set_index("doc_id")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for doc_id, text in rows:
        ids = library.encode(text or "", add_eos=True)
        r = got.loc[doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_language(spark, docs):
    got = run(spark, "op10_language").set_index("doc_id")
    assert got.held_out.to_dict() == {i: fold(i) == 0 for i in docs.doc_id} and got.score.between(0, 1).all()
    for r in docs.itertuples():
        letters = re.search(r"[^\W\d_]", r.text or "")
        assert (got.lang_pred[r.doc_id] == "und") == (letters is None)
    own = docs[docs.lang.notna() & docs.doc_id.map(lambda i: fold(i) == 0)]
    assert (got.lang_pred[own.doc_id].to_numpy() == own.lang).mean() > 0.95
