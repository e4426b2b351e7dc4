"""Document fingerprints: a canonical exact digest, grouped by a wide hash and compared by bytes inside equal buckets.

The canonical form is NFKC, case folded, NFKC again, with every run of white space as one space. Its fingerprint is its
128-bit xxh3 digest in hex; documents whose canonical bytes differ although their digests agree get an ordinal after it.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, with_columns, with_field, written


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", drop: tuple[str, ...] = (), name=digest) -> DataFrame:
    """df with the canonical digest of each whole text; null counts as empty. Equal canonical forms, equal digests."""
    col = df.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield with_columns(part, {out: pa.array([name(canonical(x)) for x in texts(part.column(col))], pa.string())}, drop)

    return df.mapInArrow(run, with_field(df, (out, "string"), drop=drop))


def same_bytes(forms: DataFrame) -> DataFrame:
    """(fingerprint, form, rank) of every distinct form of (doc_id, fingerprint, form) beyond the first of its digest.

    Grouping by digest and form compares the bytes inside equal buckets; copies meet in map-side sums first, so a large
    group of copies sends one row from each task. Ranks follow the smallest doc_id, so that reruns agree.
    """
    distinct = forms.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("first"))
    order = Window.partitionBy("fingerprint").orderBy("first", "form")
    return distinct.withColumn("rank", F.row_number().over(order) - 1).where("rank > 0").drop("first")


_RESULT = (
    "kind string, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, edited_form_sha binary, form binary, packed binary, next_packed binary"
)
_NAMES = [x.split()[0] for x in _RESULT.split(",")]
_BLOCK = 400


def _compared(name, doc_id, text: str, form: bytes, following: str, next_form: bytes, kept: bytes | None) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    edited_form = canonical(edited)
    return {
        "kind": "row",
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": name(form),
        "edited_fingerprint": name(edited_form),
        "near_edited": float(form == edited_form),
        "near_next": float(form == next_form),
        "edited_form_sha": hashlib.sha256(edited_form).digest(),
        "form": kept,
    }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = dict(zip(_NAMES, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), *[pa.binary()] * 4)))
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind in kinds.items()], names=_NAMES)


def edit_likeness(docs: DataFrame, name=digest) -> DataFrame:
    """For each row of (doc_id, text): its fingerprint, the digest and fingerprint of its edited text (the last half of
    its code points replaced by the first as many of the next document by doc_id; the first follows the last), and
    whether its canonical form is that of the edited text and of the next document (1 or 0).

    Null texts are empty; a single document follows itself; null ids come first; rows of equal id follow each other by
    text; repeated rows all stay. No rows give no rows. Where forms of documents differ under one digest, each gets its
    ordinal, and so does an edited text with such a form (told by its SHA-256 beside the digest). Texts are packed with zstd and dealt by ranges of doc_id once;
    the edges between ranges are two rows per range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = written(fingerprints(docs, drop=("text",), name=name), "digests")
    # written, so that the join's two sides are plain exchanges, of which Spark can split a hot one
    shared = written(hashed.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "shared")
    marked = hashed.join(shared, "fingerprint", "left_semi").select("doc_id").distinct()

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([packer.compress(x.encode("utf-8", "surrogatepass")) for x in texts(part.column(1))], pa.binary())],
                    names=["doc_id", "packed"],
                )

    packed = docs.mapInArrow(pack, "doc_id bigint, packed binary")
    dealt = packed.unionByName(marked.withColumn("packed", F.lit(None).cast("binary"))).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")

    def follow(batches):
        packer, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor().decompress
        part, rows = TaskContext.get().partitionId(), []
        before = mark = None
        have_mark = False
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:  # a mark stands before the rows of its id: their digest is not theirs alone
                    mark, have_mark = doc_id, True
                    continue
                text = unpack(data).decode("utf-8", "surrogatepass")
                form = canonical(text)
                kept = packer.compress(form) if have_mark and mark == doc_id else None
                if before is None:
                    rows.append({"kind": "first", "part": part, "packed": data})
                else:
                    rows.append(_compared(name, *before[:3], text, form, before[3]))
                before = (doc_id, text, form, kept, data)
                if len(rows) >= _BLOCK:
                    yield _batch(rows)
                    rows = []
        if before is not None:
            rows.append({"kind": "last", "part": part, "doc_id": before[0], "packed": before[4], "form": before[3]})
        if rows:
            yield _batch(rows)

    out = written(dealt.mapInArrow(follow, _RESULT), "neighbours")
    firsts = out.where("kind = 'first'").select("part", F.col("packed").alias("next_packed"))
    order = firsts.select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part")
    )
    lasts = out.where("kind = 'last'").drop("next_packed").join(order, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part").select(*_NAMES)

    def close(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, following = (unpack(r[k]).decode("utf-8", "surrogatepass") for k in ("packed", "next_packed"))
                rows.append(_compared(name, r["doc_id"], text, canonical(text), following, canonical(following), r["form"]))
            yield _batch(rows)

    def told(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            shas = [hashlib.sha256(unpack(x)).digest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), batch.column(2)], names=["edited_fingerprint", "edited_form_sha", "edited_rank"])

    rows = out.where("kind = 'row'").unionByName(lasts.mapInArrow(close, _RESULT))
    clashes = same_bytes(rows.where("form IS NOT NULL").select("doc_id", "fingerprint", "form"))
    if not clashes.isEmpty():
        clashes = written(clashes, "clashes")
        edited = clashes.select("fingerprint", "form", "rank").mapInArrow(told, "edited_fingerprint string, edited_form_sha binary, edited_rank int")
        rows = rows.join(clashes, ["fingerprint", "form"], "left").join(edited, ["edited_fingerprint", "edited_form_sha"], "left")
        for of, rank in (("fingerprint", "rank"), ("edited_fingerprint", "edited_rank")):
            rows = rows.withColumn(of, F.when(F.col(rank).isNull(), F.col(of)).otherwise(F.concat_ws("-", of, rank)))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
