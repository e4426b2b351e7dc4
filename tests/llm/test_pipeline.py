"""Each stage of the pipeline against brute force on the smallest tables, and on odd rows."""

from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidemark.llm.common import written  # noqa: E402

from .test_near import grouped, shingle_counts, similarity  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(DATA)), name)
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(s.columns) == list(corpus_pipeline.COLUMNS) for s in stages[:-1])


def test_quality_keeps_labelled_good_rows(stages):
    import pandas as pd

    labels = pd.read_parquet(DATA / "labels.parquet")
    kept = set(stages[1].doc_id)
    good = labels[labels.quality == 1].doc_id
    bad = labels[labels.quality == 0].doc_id
    assert np.mean([i in kept for i in good]) > 0.95 and np.mean([i in kept for i in bad]) < 0.2


def test_one_of_each_group(stages):
    sets = {i: shingle_counts(t) for i, t in zip(stages[1].doc_id, stages[1].text)}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if similarity(sets[a], sets[b]) >= 0.8]
    groups = grouped(ids, links)
    assert sorted(stages[2].doc_id) == sorted(i for i in ids if groups[i] == i)


def test_repeats_are_cut(stages):
    seen, want = set(), {}
    for i, t in sorted(zip(stages[2].doc_id, stages[2].text)):
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        want[i] = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
    assert dict(zip(stages[3].doc_id, stages[3].text)) == want
    assert (stages[3].n_chars == stages[3].text.str.len()).all()


def test_mix_and_ids(stages):
    size = lambda t: len(t.encode().split())
    before, after = stages[3], stages[4]
    total = before.text.map(size).sum()
    assert abs(after.text.map(size).sum() - 1.5 * total) < 0.02 * total
    assert (after.groupby("doc_id").size() <= 3).all()
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, tuple(model.encode(t, add_eos=True))) for i, t in zip(after.doc_id, after.text))
    assert sorted((i, tuple(x)) for i, x in zip(stages[5].doc_id, stages[5].ids)) == want


def test_odd_rows_do_not_break_a_stage(spark, documents, empty):
    odd = documents.withColumn("score", F.lit("x")).withColumn("size", F.lit(None).cast("string")).withColumn("ids", F.lit(1))
    for docs in (empty, odd, odd.unionByName(odd.limit(5))):
        known = {r["doc_id"] for r in docs.select("doc_id").collect()}
        for name, stage in corpus_pipeline.STAGES:
            got = [r["doc_id"] for r in stage(spark, docs, str(DATA)).select("doc_id").collect()]
            assert set(got) <= known and bool(got) == bool(known), name
