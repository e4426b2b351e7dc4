import hashlib

from pyspark.sql import functions as F

from tidemark.llm import fingerprint


def test_canonical_forms():
    form = fingerprint.canonical
    assert form("Ａ  B\n c") == form("a b C") == b"a b c"
    assert form("Straße") == form("STRASSE")
    assert form("é") == form("é")
    assert form("a b") != form("ab")


def test_edits_against_brute_force(documents, corpus):
    rows = sorted((r[0], r[1] or "") for r in corpus)
    got = {r["doc_id"]: r for r in fingerprint.edit_likeness(documents.withColumn("packed", F.lit(1))).collect()}
    assert len(got) == len(rows)
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        form = fingerprint.canonical
        assert r["near_edited"] == float(form(text) == form(edited))
        assert r["near_next"] == float(form(text) == form(following))
        assert r["fingerprint"] == fingerprint.digest(form(text))


def test_collisions_get_ordinals(spark):
    forms = spark.createDataFrame([(3, "h", b"x"), (1, "h", b"y"), (2, "h", b"y"), (4, "g", b"z")], "doc_id long, fingerprint string, form binary")
    assert [(r["form"], r["rank"]) for r in fingerprint.same_bytes(forms).collect()] == [(b"x", 1)]


def test_empty_single_and_repeated(spark, empty):
    assert fingerprint.edit_likeness(empty).count() == 0
    one = spark.createDataFrame([(7, "abcd")], "doc_id bigint, text string")
    r = fingerprint.edit_likeness(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and r["near_next"] == 1.0
    assert fingerprint.edit_likeness(one.unionByName(one)).count() == 2


def test_equal_forms_share_a_name_where_digests_clash(spark):
    """With a digest that tells three forms apart at most, documents of different forms get different names, and a
    document or edited text of an equal form gets the same one; null ids, very long and repeated rows included."""
    long = "x y " * 600_000
    rows = [(None, "Abcd"), (1, "abcd"), (2, "ab"), (3, "abab"), (4, None), (5, ""), (6, "AB"), (6, "AB"), (7, long), (8, "abab"), (9, long + "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fingerprint.edit_likeness(df, name=lambda form: str(len(form) % 3)).collect()
    ordered = sorted((r[0] is not None, r[0] or 0, r[1] or "") for r in rows)
    assert len(got) == len(rows)
    form, name_of = fingerprint.canonical, {}
    texts_of = {}
    for k, (known, doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        texts_of.setdefault((doc_id if known else None, hashlib.sha256(edited.encode()).hexdigest()), []).append((form(text), form(edited)))
    edits = []
    for r in got:
        plain, edited = texts_of[(r["doc_id"], r["edited_sha256"])][0]
        assert name_of.setdefault(plain, r["fingerprint"]) == r["fingerprint"]
        edits.append((edited, r["edited_fingerprint"]))
    assert len(set(name_of.values())) == len(name_of)
    assert all(name_of[e] == named for e, named in edits if e in name_of) and any(e in name_of and "-" in named for e, named in edits)
