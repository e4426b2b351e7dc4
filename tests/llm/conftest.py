import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(draw, n, words=400):
    pool = [f"w{k}" for k in range(words)]
    return " ".join(draw.choice(pool) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with copies, near copies, shared passages, nulls, empty, blank, periodic and long texts, one language switch."""
    draw = random.Random(8)
    passage = prose(draw, 60)
    texts = [prose(draw, draw.randint(30, 200)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " end", " ".join(texts[2].split()[:-2] + ["x", "y"])]
    texts += [prose(draw, 40) + " " + passage + " " + prose(draw, 40) for _ in range(6)]
    texts += ["", None, " \n\t ", "short text", "Rep " * 300, "ab" * 400, "é" * 150 + passage, prose(draw, 4000), passage + "\n" + passage]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k, t, ["en", "de", None][k % 3], ["a", "b", None, "ü"][k % 4], None if t is None else len(t)))
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
