"""Canonical exact digests: normalise, fold, hash widely, then compare bytes inside equal digests.

Only digests travel for a document without a copy. The text of the others is
combined in each batch and each task first, so a text with thousands of copies
moves once a task; grouping them by digest and text compares the bytes. Where two
texts have one digest, documents are grouped by the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from unicodedata import is_normalized, normalize

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import BROADCAST_LIMIT, cut, lean, release, row_slices, table

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])
_TEXTS = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("canon", pa.binary())])
_CLASHED = pa.schema([("doc_id", pa.int64()), ("canon", pa.binary())])
#: Bytes that a digest takes in the set that executors look in.
DIGEST_BYTES = 160


def canonical(text: str) -> bytes:
    """Compatibility form, case folding, and one space for each run of white space."""
    if text.isascii():
        text = text.lower()
    else:
        text = text.casefold() if is_normalized("NFKC", text) else normalize("NFKC", text).casefold()
        if not is_normalized("NFKC", text):
            text = normalize("NFKC", text)
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def _halves(canon: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_digest(canon)
    return int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_slices(batches, "text"):
        halves = [_halves(canonical(t)) for t in batch.column("text").to_pylist()]
        if halves:
            hi, lo = zip(*halves)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], schema=_DIGESTS)


def _texts(shared, documents: bool = False):
    """(digest, text), each text once a batch, or (document, text) of every row; with ``shared`` only those of the listed digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared is not None else None
        for batch in row_slices(batches, "text", 16 << 20):
            found: dict[bytes, tuple[int, int] | None] = {}
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                canon = canonical(t)
                if canon not in found:
                    halves = _halves(canon)
                    found[canon] = halves if wanted is None or halves in wanted else None
                if documents and found[canon]:
                    rows.append((i, canon))
            rows = rows if documents else [(*h, c) for c, h in found.items() if h]
            schema = _CLASHED if documents else _TEXTS
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _texts_of(src: DataFrame, digests: DataFrame, limit: int, documents: bool = False) -> DataFrame:
    """What ``_texts`` gives for the listed digests; they are sent to the executors if they take ``limit`` bytes or less."""
    if digests.count() * DIGEST_BYTES <= limit:
        got = digests.toArrow()
        shared = src.sparkSession.sparkContext.broadcast(set(zip(got.column(0).to_pylist(), got.column(1).to_pylist())))
        return src.mapInArrow(lean(_texts(shared, documents)), "doc_id long, canon binary" if documents else "hi long, lo long, canon binary")
    if documents:  # by the text's digest, worked out again
        keyed = src.mapInArrow(lean(_digests), "doc_id long, hi long, lo long").join(digests.hint("shuffle_hash"), ["hi", "lo"], "left_semi").select("doc_id").distinct()
        return src.join(keyed, "doc_id", "left_semi").mapInArrow(lean(_texts(None, True)), "doc_id long, canon binary")
    return src.mapInArrow(lean(_texts(None)), "hi long, lo long, canon binary").join(digests.hint("shuffle_hash"), ["hi", "lo"], "left_semi")


def exact_groups(docs: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """For each document (doc_id) the least doc_id with the same canonical text (group_id) and how many rows have that text (n_copies).

    An empty or blank text is a text like any other. Rows with a null doc_id or
    text are left out; repeated rows count as copies and stay repeated. Other
    columns are ignored; an empty table gives no rows.
    """
    src = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    digests = cut(src.mapInArrow(lean(_digests), "doc_id long, hi long, lo long"), "digests")
    group = [F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies")]
    counted = digests.groupBy("hi", "lo").agg(*group)
    several = cut(counted.where("n_copies > 1").select("hi", "lo"), "repeated-digests")
    texts = _texts_of(src, several, broadcast_limit).groupBy("hi", "lo", "canon").agg(F.lit(1).alias("one"))
    clashed = cut(texts.groupBy("hi", "lo").count().where("count > 1").select("hi", "lo"), "clashed-digests")
    release(several)
    out = digests.join(counted, ["hi", "lo"]).select("doc_id", "group_id", "n_copies", "hi", "lo")
    if not clashed.isEmpty():
        own = cut(_texts_of(src, clashed, broadcast_limit, True), "clashed-texts")
        own = own.join(own.groupBy("canon").agg(*group), "canon").select("doc_id", "group_id", "n_copies")
        out = out.join(clashed, ["hi", "lo"], "left_anti").select("doc_id", "group_id", "n_copies").unionByName(own)
    return out.select("doc_id", "group_id", "n_copies")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\s+', ' ', 'g')) AS canon FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, min(doc_id) OVER (PARTITION BY canon) AS group_id, count(*) OVER (PARTITION BY canon) AS n_copies FROM d
"""
