"""Repeated passages by a blockwise suffix sort with a difference-cover sample.

Suffixes start at words. ``COVER`` is a difference cover modulo ``PERIOD``: for
any two positions i and j there is a shift below ``PERIOD`` that brings both
into the sample of positions whose remainder is in the cover.

1. Cover-sample ranks: each sample position gets the name of its
   ``length - PERIOD + 1`` words, and one exchange tells which names occur more
   than once in the corpus. Two suffixes that agree for ``length`` words have,
   at their shift, sample positions of the same name. So a position none of
   whose sample positions within a period is repeated is unique and isn't sorted.
2. What is left are fragments of documents. Their suffixes are dealt to buckets
   by the name of their first words; a bucket is sorted by one task at a time.
   The name has two parts: 16 bits for the first ``PERIOD`` words, which order
   the bucket, and 48 for all ``length`` words, which decide long ties. A name
   takes eight bytes however long the tie is, which bounds the memory.
3. Suffixes that still tie start a passage that occurs elsewhere; those of one
   document that overlap or touch make one span.

Names are hashes of word sequences, taken from prefix sums, so the order is one
of names and not of words; repeats depend on equality alone. Words aren't
compared: of m different passages with the same first ``PERIOD`` words two get
one name with a chance of about m * m / 2**49.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.common import cut, int_column, pinned, row_slices, table, text_bytes
from vellumine.llm.exchange import Block, repeated_keys

U = np.uint64
LENGTH = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK_WORDS = 1 << 21

SPANS = "doc_id long, start_word long, n_words long, least_copies long, most_copies long"
_SPANS = pa.schema([(x.split()[0], pa.int64()) for x in SPANS.split(", ")])
_FRAGMENTS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
_CLASS = W.word_class(W.SPACES)


def _within(bounds: np.ndarray) -> np.ndarray:
    """Position of each word in its document."""
    counts = np.diff(bounds)
    return np.arange(int(bounds[-1])) - np.repeat(bounds[:-1], counts)


def _sample_names(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, name) of the cover sample."""
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    whole = W.inside(w.bounds, size)
    at = np.flatnonzero(cover[_within(w.bounds)[: len(whole)] % PERIOD] & whole)
    return at, W.window_hashes(w.hashes, size)[at] if len(at) else np.empty(0, U)


def _suffix_names(w: W.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, name) of every suffix of ``length`` words or more."""
    at = np.flatnonzero(W.inside(w.bounds, length))
    if not len(at):
        return at, np.empty(0, U)
    head, whole = W.window_hashes(w.hashes, PERIOD)[at], W.window_hashes(w.hashes, length)[at]
    return at, (head & U(0xFFFF << 48)) | (W.mix(whole) >> U(16))


def _words(data: np.ndarray, offs: np.ndarray) -> W.Words:
    return W.hash_words(pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(offs)), pa.py_buffer(data)), _CLASS, lower=False)


def _sample_blocks(length: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        press = zstandard.ZstdCompressor(3)
        ids, datas, sizes, keys, refs, done = [], [], [], [], [], 0

        def block() -> Block:
            return (np.concatenate(ids), np.concatenate(sizes), press.compress(b"".join(datas))), np.concatenate(keys), np.concatenate(refs), None

        for batch in row_slices(batches, "text"):
            values, null = int_column(batch, "doc_id")
            batch, values = batch.filter(pa.array(~null)), values[~null]
            data, offs = text_bytes(batch.column("text"), True)
            w = _words(data, offs)
            at, name = _sample_names(w, length - PERIOD + 1)
            ids.append(values), datas.append(data.tobytes()), sizes.append(np.diff(offs))
            keys.append(name), refs.append((at + done).astype(np.uint32))
            done += len(w.hashes)
            if done >= BLOCK_WORDS:
                yield block()
                ids, datas, sizes, keys, refs, done = [], [], [], [], [], 0
        if ids:
            yield block()

    return make


def _fragments(length: int):
    """Pieces of documents that hold every position with a repeated sample position within a period, with ``length`` words of each."""

    def finish(extra, keys: np.ndarray, refs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, sizes, blob = extra
        if not len(refs):
            return
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        w = _words(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        n = len(w.hashes)
        near = np.zeros(n + 1, np.int64)
        np.add.at(near, np.maximum(refs - PERIOD + 1, 0), 1)
        np.add.at(near, refs + 1, -1)
        live = np.cumsum(near)[:n] > 0
        at = np.flatnonzero(live[: max(0, n - length + 1)] & W.inside(w.bounds, length))
        if not len(at):
            return
        doc = np.searchsorted(w.bounds, at, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > length) | (np.diff(doc) > 0)]))
        first, last, doc = at[new], at[np.append(new[1:], len(at)) - 1] + length, doc[new]
        raw = data.tobytes()
        text = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[last - 1].tolist())]
        out = pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(first - w.bounds[doc]), pa.array(text, pa.string())], schema=_FRAGMENTS)
        yield from row_slices(iter([out]), "text", 16 << 20)

    return finish


def _suffix_blocks(length: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        ids, starts, counts, keys, refs, done = [], [], [], [], [], 0

        def block() -> Block:
            return (np.concatenate(ids), np.concatenate(starts), np.concatenate(counts)), np.concatenate(keys), np.concatenate(refs), None

        for batch in row_slices(batches, "text"):
            w = _words(*text_bytes(batch.column("text"), False))
            at, name = _suffix_names(w, length)
            ids.append(int_column(batch, "doc_id")[0]), starts.append(int_column(batch, "start")[0]), counts.append(np.diff(w.bounds))
            keys.append(name), refs.append((at + done).astype(np.uint32))
            done += len(w.hashes)
            if done >= BLOCK_WORDS:
                yield block()
                ids, starts, counts, keys, refs, done = [], [], [], [], [], 0
        if ids:
            yield block()

    return make


def _spans(length: int):
    def finish(extra, keys: np.ndarray, refs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, starts, sizes = extra
        if not len(refs):
            return
        order = np.argsort(refs)
        at, copies = refs[order], counts[order].astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        frag = np.searchsorted(bounds, at, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > length) | (np.diff(frag) > 0)]))
        first, last, f = at[new], at[np.append(new[1:], len(at)) - 1] + length, frag[new]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (ids[f], starts[f] + first - bounds[f], last - first, np.minimum.reduceat(copies, new), np.maximum.reduceat(copies, new))], schema=_SPANS
        )

    return finish


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The spans of each document that lie in passages of ``length`` words or more which occur more than once in the corpus.

    Columns doc_id, start_word, n_words, least_copies, most_copies: over the
    ``length``-word windows of the span that are repeated, how often the rarest
    and the most frequent one occurs. Repeated windows that overlap or touch
    make one span. Occurrences inside one document count, so a document that
    only repeats itself has spans too. Words are runs of
    other than ASCII white space, in lower case.

    ``length`` is more than ``PERIOD``. Null, empty and short texts have no
    spans, rows with a null doc_id are left out, repeated rows count as copies
    and give equal rows. Other columns are ignored; an empty table gives no rows.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be more than {PERIOD}")
    src = pinned(docs.select(F.col("doc_id").cast("long"), "text"), "suffix-docs")
    fragments = cut(repeated_keys(src, _sample_blocks(length), _fragments(length), "doc_id long, start long, text string", bits=64, with_keys=False), "fragments")
    return repeated_keys(fragments, _suffix_blocks(length), _spans(length), SPANS, bits=64, with_keys=False)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r\f\v]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT r, doc_id, i - 1 AS p, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS h FROM d, unnest(range(1, len(w) - {LENGTH} + 2)) AS t(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g),
s AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM c WHERE n > 1),
i AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM s)
SELECT doc_id, min(p) AS start_word, max(p) - min(p) + {LENGTH} AS n_words, min(n) AS least_copies, max(n) AS most_copies FROM i GROUP BY r, doc_id, k
"""
