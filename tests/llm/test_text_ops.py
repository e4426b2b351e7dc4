import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import chat, language, mixing, piece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_as_the_library(documents, corpus, spark, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(6)
    alphabet = "abcdeé ßÑ.,\n  ▁0129😀ⓐ门\t\0\x01\x7f½²Ⅷ"
    odd = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 40))) for _ in range(1500)] + [" " * n + "x" for n in range(1, 60)]
    odd += ["a \0b", "\0", " \0\0", "\0▁a", "a\n\0b", "\0 \n▁\0", "word " * 60_000 + "x" * 5_000 + " \0end"]
    rows = [(1000 + k, t) for k, t in enumerate(odd)] + [(r[0], r[1]) for r in corpus]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("taken"))
    got = {r["doc_id"]: r for r in piece_codec.decode(piece_codec.encode(df, MODEL, bos=True, decoded="both"), MODEL).collect()}
    for k, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k]["ids"] == ids
        assert got[k]["decoded"] == got[k]["both"] == library.decode(ids)
    assert piece_codec.encode(empty, MODEL).count() == 0


def test_decoding_any_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(7)
    rows = [(k, [draw.choice([draw.randrange(32000), draw.randrange(3, 259), draw.choice([0, 1, 2, 259])]) for _ in range(draw.randint(0, 8))]) for k in range(400)] + [(999, None)]
    got = piece_codec.decode(spark.createDataFrame(rows, "k bigint, ids array<int>"), MODEL).collect()
    assert {r["k"]: r["decoded"] for r in got} == {k: library.decode(ids or []) for k, ids in rows}


def test_chat_round_trip(spark):
    odd = ["<|done|>", "<|turn|>user<|says|>", "</s>[INST] ok [/INST]", "<\\|", "\\<s>", "[\\INST]", "", None, "<<|\\|>", "a\nb"]
    rows = [(k, t, ["user", "assistant", "system"][t % 3], odd[(k + t) % len(odd)]) for k in range(10) for t in range(5)]
    rows += [(20, 0, "assistant", "x"), (20, 0, "assistant", "x"), (21, None, None, "y"), (None, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    out = out.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("said", chat.masked_text(F.col("formatted"), F.col("loss_mask")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {*range(10), 20, 21, None}
    for k in {r[0] for r in rows}:
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == k), key=lambda r: r[0])
        assert [(t["role"], t["body"]) for t in got[k]["turns"]] == [r[1:] for r in own]
        assert got[k]["said"] == "".join(r[2] for r in own if r[1] == "assistant")
    assert chat.format_chats(df.limit(0).select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "img1", 64), None, ("audio", None, "a1", None), ("video", None, "v1", 7), (None, "end", None, None)]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert r["expanded_tokens"] == 71
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "img1", 64), ("audio", "a1", 0), ("video", "v1", 7)]
    for a, mark in zip(r["attachments"], ("<|image|>", "<|audio|>", "<|file|>")):
        assert r["formatted"][a["at"] : a["at"] + len(mark)] == mark


def test_a_long_conversation_with_equal_turns(spark):
    """Equal turns go by role, then text; repeated rows stay; all spans of a conversation of 6,000 turns are where the texts are."""
    rows = [(1, k // 3, "assistant" if k % 3 == 1 else None if k % 3 == 2 else "user", f"{'a' * (k % 5)}<s>[INST] {k % 7}") for k in range(5_998)]
    rows += [(1, None, "assistant", "first")] * 2 + [(None, 0, "assistant", "own")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = df.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))
    out = {r["conv_id"]: r for r in chat.format_chats(parts).select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("said"), F.size("loss_mask").alias("spans")).collect()}
    want = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3]) for r in rows if r[0] == 1))
    assert [(t["role"], t["body"]) for t in out[1]["turns"]] == [w[2:] for w in want]
    said = [w[3] for w in want if w[2] == "assistant"]
    assert out[1]["said"] == "".join(said) and out[1]["spans"] == len(said)
    assert out[None]["said"] == "own"


def test_mix(spark, documents, corpus, empty):
    sized = documents.withColumn("size", mixing.size_of(F.col("text")))
    mixed = mixing.mix(sized).cache()
    rows = mixed.collect()
    assert len(rows) == len(corpus)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        own = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        own[0] += r["taken"]
        own[1] += r["size"]
    total = sum(v[1] for v in by.values())
    assert abs(sum(v[2] for v in by.values()) - 1.5 * total) < 1e-6
    assert all(v[1] == v[3] and v[2] <= 2 * v[1] + 1e-9 and abs(v[0] - v[2]) <= 2 * mixing.LEAST_BLOCK for v in by.values())
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(sized.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    taken = mixing.take(mixed, documents.columns).collect()
    words = lambda t: len([w for w in t.encode().split()])
    sums = {}
    for r in taken:
        assert r["n_chars"] == len(r["text"])
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + words(r["text"])
    assert sums == {r["doc_id"]: r["taken"] for r in rows if r["taken"]}
    assert mixing.mix(empty.withColumn("size", F.lit(0).cast("long"))).count() == 0


def test_clashing_columns(spark, documents):
    """Columns that are called like the plan's are replaced; any others stay."""
    sized = documents.withColumn("size", mixing.size_of(F.col("text")))
    want = {(r["doc_id"], r["taken"]) for r in mixing.mix(sized).collect()}
    ours = [c for c in mixing.PLAN if c != "size"] + ["shards", "quota", "seats", "one", "hash", "name", "row", "shard", "level", "weight", "total", "_v", "_q", "_h", "_source", "a.b"]
    for name in [*ours, "Block"]:
        sized = sized.withColumn(name, F.lit("x")) if name != "Block" else sized.withColumnRenamed("block", "Block")
    mixed = mixing.mix(sized)
    got = mixed.collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == want
    assert {r["quota"] for r in got} == {r["a.b"] for r in got} == {"x"} and {r["block"] for r in got} == {mixing.LEAST_BLOCK}
    assert mixing.take(mixed, ["doc_id", "text", "quota"]).count() > 0


def test_small_sources_beside_a_large_one(spark):
    """A source gets its target however large the others are."""
    large = spark.range(256).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit(1 << 20).cast("long").alias("size"))
    small = [(1000 + k, source, size) for source, sizes in (("b", (30, 20)), ("c", (40, 60)), ("d", (900, 600))) for k, size in enumerate(sizes)]
    docs = large.unionByName(spark.createDataFrame(small, "doc_id bigint, source string, size bigint"))
    got = mixing.mix(docs.repartition(8)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r["source"] for r in got} == set("abcd")
    for r in got:
        shards = 257 if r["source"] == "a" else 1
        assert abs(r["taken"] - r["target"]) <= 2 * mixing.LEAST_BLOCK * shards, r


def test_highest_quotients(spark):
    votes = [53, 24, 23, 0, 7]
    df = spark.createDataFrame([("g", k, v, 13) for k, v in enumerate(votes)], "g string, k int, votes bigint, seats bigint")
    got = {r["k"]: r["out"] for r in mixing.apportion(df, ["g"], ["k"], "votes", "seats", "out").collect()}
    seats = [0] * len(votes)
    for _ in range(13):
        best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    assert [got[k] for k in range(len(votes))] == seats


def test_languages(spark, empty):
    draw = random.Random(9)
    pools = {"en": ["the", "thing", "water", "with", "was"], "de": ["der", "schön", "ich", "nicht", "über"], "es": ["el", "niño", "agua", "que", "mañana"]}
    rows = []
    for k in range(300):
        lang = draw.choice(sorted(pools))
        rows.append((k, " ".join(draw.choice(pools[lang]) + draw.choice(["", "s", "en"]) for _ in range(30)), lang))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(language.sample(docs))
    odd = [(900, None, None), (901, "123 !!", None), (902, "", "en"), (903, "½ ² Ⅷ ①", None)]
    got = language.predict(docs.unionByName(spark.createDataFrame(odd, docs.schema)), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got if r["doc_id"] < 900)
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 900} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.predict(empty, model).count() == 0
    assert language.fit(language.sample(empty)).languages == []
    assert language.words_of("Ab½c x9y ² Ñé 一") == ["ab", "c", "x", "y", "ñé", "一"]
    # words of a switched text are told apart
    import numpy as np

    mixed = ["the", "water", "was", "der", "schön", "nicht"] * 1
    p, _, _ = language.posteriors(model.emissions(mixed), model.transitions, np.array([6]))
    assert [model.languages[c] for c in p.argmax(axis=1)] == ["en"] * 3 + ["de"] * 3


def test_forward_backward_against_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    p, _, _ = language.posteriors(e, t, np.array([5]))
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(sum(e[k, c] for k, c in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for k, c in enumerate(path):
            want[k, c] += w
    assert np.allclose(p, want / want.sum(axis=1, keepdims=True))




def test_slopes_against_differences():
    """The slopes that training follows are those of the log likelihood, summed over all paths by hand."""
    import itertools

    import numpy as np

    texts = [("en", "the water"), ("de", "der schön"), ("en", "was thing the"), ("de", "nicht"), ("en", "water"), ("de", "ich der")] * 2
    model, training = language.prepared(texts, np.random.default_rng(3))
    rng = np.random.default_rng(8)
    model.grams, model.entries = rng.normal(size=model.grams.shape) / 4, rng.normal(size=model.entries.shape)
    model.grams[0], model.entries[-1] = 0, 0
    model.transitions = rng.normal(size=(2, 2))
    assert len(model.entries) > 2 and training.lengths.max() <= 9

    def likelihood():
        e, total, at = training.emissions(model), 0.0, 0
        for n in training.lengths:
            weight = lambda path: sum(e[at + k, c] for k, c in enumerate(path)) + sum(model.transitions[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            total += weight(training.label[at : at + n]) - np.logaddexp.reduce([weight(p) for p in itertools.product(range(2), repeat=int(n))])
            at += n
        return total

    slopes, step = training.slopes(model), 1e-5
    used = np.unique(np.concatenate(training.grams))[1:]
    chosen = [(model.grams, slopes[0], (int(k), c)) for k in rng.choice(used, 8, replace=False) for c in (0, 1)]
    chosen += [(model.entries, slopes[1], (k, c)) for k in range(len(model.entries) - 1) for c in (0, 1)]
    chosen += [(model.transitions, slopes[2], (a, b)) for a in (0, 1) for b in (0, 1)]
    for weights, slope, at in chosen:
        before = weights[at]
        weights[at] = before + step
        above = likelihood()
        weights[at] = before - step
        below = likelihood()
        weights[at] = before
        assert abs((above - below) / (2 * step) - slope[at]) < 1e-6
    assert not slopes[0][0].any() and not slopes[1][-1].any()


def test_training_raises_the_likelihood(monkeypatch):
    import numpy as np

    texts = [("en", "the water was the thing " * 3), ("de", "der schön ich nicht über " * 3), ("es", "el niño agua que mañana " * 3)] * 4
    right = []
    for rounds in (0, 1, 5, 20):
        monkeypatch.setattr(language, "ROUNDS", rounds)
        model = language.fit(texts)
        training = language.prepared(texts, np.random.default_rng(5))[1]
        p, _, _ = language.posteriors(training.emissions(model), model.transitions, training.lengths)
        right.append(np.log(p[np.arange(len(p)), training.label]).mean())
    assert right == sorted(right) and right[-1] > -0.05
