"""Benchmark decontamination by winnowing.

Word k-grams are hashed and, in each run of ``WINDOW`` of them, the least one is
kept as a fingerprint, in documents and benchmark alike. A passage of
``K + WINDOW - 1`` words that both have holds a whole run, so both keep the same
fingerprint of it: every shared span of that length is found. Fingerprints that
meet are extended to both sides as far as the words agree.

A benchmark of up to ``CHUNK_BYTES`` is sent to every executor and joined there
in one pass. A larger one is joined by a shuffle of fingerprints, and only texts
that share one with an item travel to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.common import BROADCAST_LIMIT, cut, doc_chunks, int_column, lean, row_slices, table

U = np.uint64
K, WINDOW = 8, 6
#: Shortest shared span that counts, in words, and the length from which none is missed.
MIN_SPAN = K + WINDOW - 1
#: Text of benchmark items, in bytes, that is sent to every executor; a word takes some 20 bytes there.
CHUNK_BYTES = BROADCAST_LIMIT // 4

#: Pairs of places that are looked at in one go.
HITS = 1 << 21

_CLASS = W.word_class(W.SPACES + W.PUNCTUATION)
SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, item_words long"
_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


class Items(NamedTuple):
    ids: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray
    prints: np.ndarray  #: sorted fingerprints
    at: np.ndarray  #: where each one starts in ``hashes``
    printed: np.ndarray  #: for each word, whether a fingerprint starts there


def winnow(hashes: np.ndarray, bounds: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the k-grams that are least in some run of ``window`` inside their document; of equal ones all are kept."""
    grams = W.window_hashes(hashes, k)
    least = W.sliding_min(grams, window)
    whole = W.inside(bounds, k + window - 1)[: len(least)]
    keep = np.zeros(len(grams), bool)
    for o in range(window):
        keep[o : o + len(least)] |= whole & (grams[o : o + len(least)] == least)
    at = np.flatnonzero(keep)
    return at, grams[at]


def _items(batch: pa.Table, k: int, window: int) -> Items:
    w = W.hash_words(batch.column("text"), _CLASS)
    at, prints = winnow(w.hashes, w.bounds, k, window)
    order = np.argsort(prints, kind="stable")
    return Items(int_column(batch, "item_id")[0], w.hashes, w.bounds, prints[order], at[order], _marked(len(w.hashes), at))


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _extend(docs: np.ndarray, doc_lo: np.ndarray, doc_hi: np.ndarray, items: np.ndarray, item_lo: np.ndarray, item_hi: np.ndarray, d: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and last+1 document positions to which each meeting pair (d, i) extends."""
    lo, hi = d.copy(), d.copy()
    shift = i - d
    live = np.arange(len(d))
    while len(live):
        p = lo[live] - 1
        ok = (p >= doc_lo[live]) & (p + shift[live] >= item_lo[live])
        ok[ok] = docs[p[ok]] == items[(p + shift[live])[ok]]
        live = live[ok]
        lo[live] -= 1
    live = np.arange(len(d))
    while len(live):
        p = hi[live]
        ok = (p < doc_hi[live]) & (p + shift[live] < item_hi[live])
        ok[ok] = docs[p[ok]] == items[(p + shift[live])[ok]]
        live = live[ok]
        hi[live] += 1
    return lo, hi


def _hits(it: Items, text: pa.Array, k: int, window: int) -> np.ndarray:
    """Rows (document number, item number, document start, item start, words) of every shared span that is long enough.

    Of fingerprints that meet one word after the other only the first is
    extended, so words that repeat in both cost a step for each pair of places,
    not the length of their span.
    """
    w = W.hash_words(text, _CLASS)
    at, prints = winnow(w.hashes, w.bounds, k, window)
    a, b = np.searchsorted(it.prints, prints), np.searchsorted(it.prints, prints, "right")
    hit = np.flatnonzero(b > a)
    printed, out = _marked(len(w.hashes), at), []
    pairs = np.cumsum((b - a)[hit])
    for lo, hi in doc_chunks(np.concatenate([[0], pairs]), np.concatenate([[0], pairs]), HITS) if len(hit) else ():
        own = hit[lo:hi]
        n = (b - a)[own]
        d = np.repeat(at[own], n)
        i = it.at[np.repeat(a[own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
        doc, item = np.searchsorted(w.bounds, d, "right") - 1, np.searchsorted(it.bounds, i, "right") - 1
        first = (d == w.bounds[doc]) | (i == it.bounds[item]) | ~printed[d - 1] | ~it.printed[i - 1] | (w.hashes[d - 1] != it.hashes[i - 1])
        d, i, doc, item = d[first], i[first], doc[first], item[first]
        lo, hi = _extend(w.hashes, w.bounds[doc], w.bounds[doc + 1], it.hashes, it.bounds[item], it.bounds[item + 1], d, i)
        ok = hi - lo >= k + window - 1
        out.append(np.unique(np.stack([doc, item, lo - w.bounds[doc], lo + i - d - it.bounds[item], hi - lo])[:, ok], axis=1))
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.empty((5, 0), np.int64)


def _search(shared, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = shared.value
        for batch in row_slices(batches, "text"):
            ids, null = int_column(batch, "doc_id")
            doc, item, start, item_start, words = _hits(it, batch.column("text"), k, window)
            ok = ~null[doc]
            if ok.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (ids[doc], it.ids[item], start, item_start, words, np.diff(it.bounds)[item])], schema=_ARROW)

    return run


def _filter(shared, k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            keep = np.ones(batch.num_rows, bool)
            keep[_hits(shared.value, batch.column("text"), k, window)[0]] = False
            yield batch.filter(pa.array(keep))

    return run


def _items_of(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()


def _fits(items: DataFrame, limit: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) <= limit


def _key() -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2")]


def _prints(names: list[str], k: int, window: int):
    """The distinct fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            w = W.hash_words(batch.column("text"), _CLASS)
            at, prints = winnow(w.hashes, w.bounds, k, window)
            doc, prints = np.unique(np.stack([(np.searchsorted(w.bounds, at, "right") - 1).astype(U), prints]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), *(batch.column(n).take(pa.array(doc.astype(np.int64))) for n in names)], names=["print", *names])

    return run


def _verified(k: int, window: int):
    """The shared spans of each (text, item) row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                it = _items(pa.table({"item_id": row.column("item_id"), "text": row.column("item")}), k, window)
                _, _, start, item_start, words = _hits(it, row.column("text"), k, window)
                if len(start):
                    n, one = len(start), lambda c: pa.array(np.full(n, row.column(c)[0].as_py()))
                    yield pa.RecordBatch.from_arrays([one("k1"), one("k2"), one("item_id"), pa.array(start), pa.array(item_start), pa.array(words), pa.array(np.full(n, it.bounds[-1]))], names=["k1", "k2", *_ARROW.names[1:]])

    return run


def _joined(docs: DataFrame, items: DataFrame, k: int, window: int) -> DataFrame:
    """(k1, k2: the hash of a text, and the columns of a span) by a shuffle join of fingerprints; texts are read once for these and once to be extended."""
    texts = docs.select(*_key(), "text").where("text IS NOT NULL")
    own = texts.mapInArrow(lean(_prints(["k1", "k2"], k, window)), "print long, k1 long, k2 long")
    theirs = items.mapInArrow(lean(_prints(["item_id"], k, window)), "print long, item_id long").distinct()
    meet = own.join(theirs.hint("shuffle_hash"), "print").select("k1", "k2", "item_id").distinct()
    pairs = cut(meet, "fingerprint-pairs")
    hit = texts.join(pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    # an item_id may have several texts
    both = pairs.join(hit, ["k1", "k2"]).join(items.withColumnRenamed("text", "item"), "item_id")
    return both.select("k1", "k2", "item_id", "text", "item").mapInArrow(lean(_verified(k, window)), "k1 long, k2 long, " + SCHEMA.split(", ", 1)[1])


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every maximal span of at least ``k + window - 1`` words that a document shares with a benchmark item.

    Columns doc_id, item_id, doc_start, item_start (in words from 0), n_words,
    item_words, coverage (n_words / item_words). Words are runs of other than
    ASCII white space and punctuation, in lower case.

    The benchmark is measured before it is sent out; beyond ``chunk_bytes`` it is
    joined by a shuffle, with the same result. Null, empty and short texts share
    nothing, rows with a null doc_id or item_id are left out, repeated rows count
    once, an item that occurs several times in a document gives as many rows, and
    so do words that repeat in both: one for each way to lay them over each
    other. Other columns are ignored; an empty table on either side gives no rows.
    """
    src, items = docs.select(F.col("doc_id").cast("long"), "text"), _items_of(benchmark)
    if _fits(items, chunk_bytes):
        out = src.mapInArrow(lean(_search(docs.sparkSession.sparkContext.broadcast(_items(items.toArrow(), k, window)), k, window)), SCHEMA)
    else:
        src = src.where("doc_id IS NOT NULL")
        out = src.select("doc_id", *_key()).distinct().join(_joined(src, items, k, window), ["k1", "k2"]).select(_ARROW.names)
    return out.distinct().withColumn("coverage", F.col("n_words") / F.col("item_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs`` that share no span of ``k + window - 1`` words with a benchmark item, all columns.

    Nothing is shuffled up to ``chunk_bytes`` of items. Rows are judged by their
    text, with a null doc_id too; null and empty texts stay.
    """
    items = _items_of(benchmark)
    if _fits(items, chunk_bytes):
        return docs.mapInArrow(lean(_filter(docs.sparkSession.sparkContext.broadcast(_items(items.toArrow(), k, window)), k, window)), docs.schema)
    gone = _joined(docs, items, k, window).select("k1", "k2").distinct()
    k1, k2 = F.xxhash64(docs["text"]), F.xxhash64(docs["text"], F.lit(1))
    return docs.join(gone, (k1 == gone["k1"]) & (k2 == gone["k2"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r\f\v!-/:-@\[-`{-~]+')"

ORACLE_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, {WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
dg AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i:i + {MIN_SPAN - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {MIN_SPAN} + 2)) AS t(i)),
bg AS (SELECT item_id, len(w) AS item_words, i - 1 AS p, array_to_string(w[i:i + {MIN_SPAN - 1}], ' ') AS g FROM b, unnest(range(1, len(w) - {MIN_SPAN} + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, item_words, dg.p AS dp, bg.p AS ip FROM dg JOIN bg USING (g)),
r AS (SELECT *, dp - row_number() OVER (PARTITION BY doc_id, item_id, item_words, dp - ip ORDER BY dp) AS run FROM m)
SELECT doc_id, item_id, min(dp) AS doc_start, min(ip) AS item_start, count(*) + {MIN_SPAN - 1} AS n_words, CAST(item_words AS BIGINT) AS item_words,
  CAST(count(*) + {MIN_SPAN - 1} AS DOUBLE) / item_words AS coverage
FROM r GROUP BY doc_id, item_id, item_words, dp - ip, run
"""
