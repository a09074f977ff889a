"""A toxicity classifier regularised by counterfactuals.

Logistic regression over the words and word stems that a document has. Each
labelled text that names groups is also written with the groups swapped for
others, and the squared change of its score is added to the loss, over all that
the swap changes, so that naming a group doesn't count as evidence. Training
takes a bounded sample of labelled rows; every document is scored, over its
whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.common import cut, lean, release, row_slices, table

U = np.uint64
#: Labelled documents that the classifier is fitted on, at most.
TRAIN_ROWS = 20_000
#: Words and stems that get a weight, at most; they are chosen on the sample.
FEATURES = 8192
#: Words of more bytes also count by their first ones.
STEM_BYTES = 7
#: A word gets a weight if so many documents of the sample have it, and with what G statistic at least it tells the labels apart.
LEAST_DOCS, LEAST_G = 3, 12.0
L2, COUNTERFACTUAL, STEPS = 2e-4, 4.0, 400
THRESHOLD = 0.5

#: Groups that are swapped for each other, by language; words in lower case.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
_CLASS = W.word_class(W.SPACES + W.PUNCTUATION)


class Model(NamedTuple):
    keys: np.ndarray  #: sorted hashes of words and stems
    weights: np.ndarray
    bias: float


def identity_keys(groups=IDENTITY) -> np.ndarray:
    """The keys of all words that name a group and of their stems."""
    return np.unique(features(W.hash_words(pa.array([x for g in groups for x in g], pa.string()), _CLASS))[1])


def _stems(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of a longer word, key of its stem)."""
    long = np.flatnonzero(w.end - w.start > STEM_BYTES)
    stem = np.zeros(len(long), U)
    for i in range(STEM_BYTES):
        stem = stem * U(0x100000001B3) ^ W.BYTE[w.data[w.start[long] + i]]
    return long, W.mix(stem)


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document number, key) of each distinct word and of each distinct stem of a longer word."""
    doc = W.word_document(w.bounds)
    long, stem = _stems(w)
    keys, owner = np.concatenate([w.hashes, stem]), np.concatenate([doc, doc[long]])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


class Example(NamedTuple):
    """What a labelled text has, and for each way to swap its groups (keys gained, keys lost, weight)."""

    toxic: int
    keys: np.ndarray
    swaps: list[tuple[np.ndarray, np.ndarray, float]]


def examples(text: pa.Array, toxic: list[int], groups=IDENTITY) -> Iterator[Example]:
    """Each labelled text with its swaps.

    In a set of n terms every one is replaced by the one k places further, all at
    once, for each k from 1 to n - 1 with a weight of 1 / (n - 1). So a text that
    names several groups of a set names several others after it.
    """
    w = W.hash_words(text, _CLASS)
    owner, keys = features(w)
    cuts = np.searchsorted(owner, np.arange(len(text) + 1))
    stem = np.zeros(len(w.hashes), U)
    long, own = _stems(w)
    stem[long] = own
    named: dict[int, dict[int, list[tuple[int, int]]]] = {}  # document: set: (word, term)
    terms = []
    for g, names in enumerate(groups):
        t = W.hash_words(pa.array(list(names), pa.string()), _CLASS)
        t_stem = np.zeros(len(names), U)
        t_long, t_own = _stems(t)
        t_stem[t_long] = t_own
        terms.append((t.hashes, t_stem))
        order = np.argsort(t.hashes)
        at = np.minimum(np.searchsorted(t.hashes[order], w.hashes), len(names) - 1)
        for i in np.flatnonzero(t.hashes[order][at] == w.hashes).tolist():
            d = int(np.searchsorted(w.bounds, i, "right")) - 1
            named.setdefault(d, {}).setdefault(g, []).append((i, int(order[at[i]])))
    for d, y in enumerate(toxic):
        have, swaps = keys[cuts[d] : cuts[d + 1]], []
        lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
        for g, places in named.get(d, {}).items():
            hashes, stems = terms[g]
            place, term = (np.array(x) for x in zip(*places))
            for k in range(1, len(hashes)):
                word, root = w.hashes[lo:hi].copy(), stem[lo:hi].copy()
                word[place - lo], root[place - lo] = hashes[(term + k) % len(hashes)], stems[(term + k) % len(hashes)]
                new = np.unique(np.concatenate([word, root[root > 0]]))
                swaps.append((np.setdiff1d(new, have, True), np.setdiff1d(have, new, True), 1 / (len(hashes) - 1)))
        yield Example(int(y), have, swaps)


_HELD = pa.schema([("tie", pa.int64()), ("toxic", pa.int32()), ("keys", pa.binary()), ("swaps", pa.list_(pa.struct([("gained", pa.binary()), ("lost", pa.binary()), ("weight", pa.float64())])))])
HELD = "tie long, toxic int, keys binary, swaps array<struct<gained: binary, lost: binary, weight: double>>"


def _labelled(groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            made = list(examples(batch.column("text"), batch.column("toxic").to_pylist(), groups))
            if made:
                swaps = [[{"gained": a.tobytes(), "lost": b.tobytes(), "weight": x} for a, b, x in e.swaps] for e in made]
                yield pa.RecordBatch.from_arrays([batch.column("tie"), batch.column("toxic").cast(pa.int32()), pa.array([e.keys.tobytes() for e in made], pa.binary()), pa.array(swaps, _HELD.field("swaps").type)], schema=_HELD)

    return run


def _select(keys: np.ndarray, owner: np.ndarray, toxic: np.ndarray, always: np.ndarray, limit: int, least_docs: int = LEAST_DOCS, least_g: float = LEAST_G) -> np.ndarray:
    """Keys whose presence tells the classes apart (G test), and those in ``always``."""
    every, at = np.unique(keys, return_inverse=True)
    pos = np.bincount(at, weights=toxic[owner], minlength=len(every))
    n = np.bincount(at, minlength=len(every)).astype(float)
    total, ones = float(len(toxic)), float(toxic.sum())

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    g = 2 * (part(pos, n * ones / total) + part(n - pos, n * (total - ones) / total) + part(ones - pos, (total - n) * ones / total) + part(total - n - ones + pos, (total - n) * (total - ones) / total))
    g[n < least_docs] = 0
    best = np.lexsort((every, -g))[:limit]
    return np.union1d(every[best[g[best] >= least_g]], np.intersect1d(every, always))


def _places(vocab: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The columns of those of ``keys`` that have one."""
    if not len(vocab):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(vocab, keys), len(vocab) - 1)
    return at[vocab[at] == keys]


def fit(rows: list[Example], groups=IDENTITY, counterfactual: float = COUNTERFACTUAL, limit: int = FEATURES) -> Model:
    """Fit on examples held in memory."""
    toxic = np.array([e.toxic for e in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(e.keys) for e in rows])
    vocab = _select(np.concatenate([e.keys for e in rows]) if rows else np.empty(0, U), owner, toxic, identity_keys(groups), limit)
    swaps = [(_places(vocab, a), _places(vocab, b), x) for e in rows for a, b, x in e.swaps]
    return descend(toxic, [_places(vocab, e.keys) for e in rows], swaps, vocab, counterfactual)


class Loss:
    """The loss over (weights, bias): class-balanced log loss, L2, and the squared score changes of the swaps."""

    def __init__(self, toxic: np.ndarray, columns: list[np.ndarray], swaps: list[tuple[np.ndarray, np.ndarray, float]], width: int, counterfactual: float) -> None:
        self.toxic, self.width, n = toxic, width, len(toxic)
        self.doc, self.col = np.repeat(np.arange(n), [len(c) for c in columns]), np.concatenate(columns) if n else np.empty(0, np.int64)
        self.weight = np.where(toxic > 0, n / (2 * toxic.sum()), n / (2 * (n - toxic.sum()))) / n
        self.swap = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
        self.key = np.concatenate([x for a, b, _ in swaps for x in (a, b)]).astype(np.int64) if swaps else np.empty(0, np.int64)
        self.sign = np.concatenate([np.repeat([1.0, -1.0], [len(a), len(b)]) for a, b, _ in swaps]) if swaps else np.empty(0)
        self.times = counterfactual * np.array([x for _, _, x in swaps]) / n

    def changes(self, w: np.ndarray) -> np.ndarray:
        """What each swap adds to its document's score."""
        return np.bincount(self.swap, weights=self.sign * w[self.key], minlength=len(self.times))

    def value(self, w: np.ndarray, bias: float) -> float:
        z = bias + np.bincount(self.doc, weights=w[self.col], minlength=len(self.toxic))
        return float((self.weight * (np.logaddexp(0, z) - self.toxic * z)).sum() + L2 / 2 * (w * w).sum() + (self.times * self.changes(w) ** 2).sum())

    def gradient(self, w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = bias + np.bincount(self.doc, weights=w[self.col], minlength=len(self.toxic))
        e = self.weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - self.toxic)
        g = np.bincount(self.col, weights=e[self.doc], minlength=self.width) + L2 * w
        if len(self.times):
            g += np.bincount(self.key, weights=self.sign * (2 * self.times * self.changes(w))[self.swap], minlength=self.width)
        return g, float(e.sum())


def descend(toxic: np.ndarray, columns: list[np.ndarray], swaps: list[tuple[np.ndarray, np.ndarray, float]], vocab: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Weights of ``vocab`` from the columns that each document has, and those that each swap adds and takes; without both labels the model rejects nothing."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return Model(np.empty(0, U), np.empty(0), -10.0)
    loss = Loss(toxic, columns, swaps, len(vocab), counterfactual)
    w, bias = np.zeros(len(vocab)), 0.0
    m1, m2, b1, b2 = np.zeros(len(vocab)), np.zeros(len(vocab)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        g, gb = loss.gradient(w, bias)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        f = 0.1 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= f * m1 / (np.sqrt(m2) + 1e-9)
        bias -= f * b1 / (np.sqrt(b2) + 1e-9)
    return Model(vocab, w, bias)


def judged(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score, whether there is evidence) of each text: without a word that the model knows there is none, be it null or empty, and the score is at most a half."""
    w = W.hash_words(text, _CLASS)
    z, known = np.full(len(text), model.bias), np.zeros(len(text), bool)
    if len(model.keys) and len(w.hashes):
        owner, keys = features(w)
        at = np.minimum(np.searchsorted(model.keys, keys), len(model.keys) - 1)
        ok = model.keys[at] == keys
        z += np.bincount(owner[ok], weights=model.weights[at[ok]], minlength=len(text))
        known[owner[ok]] = True
    z = np.where(known, z, np.minimum(z, 0))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), known


def scores(model: Model, text: pa.Array) -> np.ndarray:
    return judged(model, text)[0]


def _toxic(model: Model, text: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    s, known = judged(model, text)
    s = np.round(s, 6)
    return s, known & (s >= threshold)


def _sample(held: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` of the held examples, those whose ties are least; a doc_id that repeats with other texts gives more than labels have rows."""
    slot = F.shiftrightunsigned("tie", 48)
    counts = sorted(held.groupBy(slot.alias("slot")).count().collect())
    total, last = 0, -1
    for slot_no, n in counts:
        if total + n > rows:
            break
        total, last = total + n, slot_no
    return held.where(slot <= last)


def train(
    docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES, least_docs: int = LEAST_DOCS, least_g: float = LEAST_G, counterfactual: float = COUNTERFACTUAL, groups=IDENTITY
) -> Model:
    """Fit on up to ``rows`` labelled documents, those whose ids hash least; see ``toxicity`` for the parameters."""
    some = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int")).where("label_id IS NOT NULL AND toxic IS NOT NULL").distinct()
    some = some.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(rows)
    known = docs.select(F.col("doc_id").cast("long"), "text").where("text IS NOT NULL").join(F.broadcast(some), F.col("doc_id") == F.col("label_id"))
    known = known.select("text", "toxic", F.xxhash64("label_id", "text", "toxic").alias("tie"))
    held = cut(known.mapInArrow(lean(_labelled(groups)), HELD), "labelled-features")
    if held.count() > rows:
        held = _sample(held.dropDuplicates(["tie"]), rows)
    total, ones = held.agg(F.count("*"), F.sum("toxic")).first()
    if not total or ones in (0, total):
        return descend(np.full(total, float(bool(ones))), [], [], np.empty(0, U))
    vocab = _select_spark(held, total, ones, identity_keys(groups), features, least_docs, least_g)
    got = held.mapInArrow(lean(_columns(vocab)), _COLUMNS).toArrow().to_pylist()
    release(held)
    # the order of arrival differs between runs; sums in another order would differ in their last bits
    got.sort(key=lambda r: (r["tie"], r["toxic"], r["columns"]))
    swaps = [(np.frombuffer(x["gained"], np.int32), np.frombuffer(x["lost"], np.int32), x["weight"]) for r in got for x in r["swaps"]]
    return descend(np.array([r["toxic"] for r in got], float), [np.frombuffer(r["columns"], np.int32) for r in got], swaps, vocab, counterfactual)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, documents that have it, toxic ones among them) of each batch."""
    for batch in batches:
        keys = [np.frombuffer(k, np.int64) for k in batch.column("keys").to_pylist()]
        if keys:
            toxic = np.repeat(batch.column("toxic").to_numpy(), [len(k) for k in keys])
            every, at = np.unique(np.concatenate(keys), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.bincount(at, minlength=len(every))), pa.array(np.bincount(at, weights=toxic, minlength=len(every)).astype(np.int64))], names=["key", "n", "pos"])


def _select_spark(held: DataFrame, total: int, ones: int, always: np.ndarray, limit: int = FEATURES, least_docs: int = LEAST_DOCS, least_g: float = LEAST_G) -> np.ndarray:
    """What ``_select`` gives, with the counting and the test done by the executors."""
    counts = held.select("toxic", "keys").mapInArrow(lean(_tally), "key long, n long, pos long").groupBy("key").agg(F.sum("n").cast("double").alias("n"), F.sum("pos").cast("double").alias("pos"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, pos, p, q = F.col("n"), F.col("pos"), ones / total, (total - ones) / total
    g = 2 * (part(pos, n * p) + part(n - pos, n * q) + part(ones - pos, (total - n) * p) + part(total - n - ones + pos, (total - n) * q))
    best = counts.where(n >= least_docs).withColumn("g", g).where(F.col("g") >= least_g).orderBy(F.desc("g"), "key").limit(limit).select("key")
    forced = counts.where(F.col("key").isin(always.view(np.int64).tolist())).select("key")
    return np.unique(best.unionAll(forced).toArrow().column(0).to_numpy().view(U))


_COLUMNS = "tie long, toxic int, columns binary, swaps array<struct<gained: binary, lost: binary, weight: double>>"


def _columns(vocab: np.ndarray):
    def place(blob: bytes) -> bytes:
        return _places(vocab, np.frombuffer(blob, U)).astype(np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            swaps = [[x | {"gained": place(x["gained"]), "lost": place(x["lost"])} for x in own] for own in batch.column("swaps").to_pylist()]
            columns = [place(k) for k in batch.column("keys").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tie"), batch.column("toxic"), pa.array(columns, pa.binary()), pa.array(swaps, _HELD.field("swaps").type)], names=["tie", "toxic", "columns", "swaps"])

    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, toxic) for every row of ``docs``; see ``toxicity``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, _toxic(shared.value, batch.column("text"), threshold))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, toxicity double, toxic boolean")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are; a text without a known word, be it null or empty, is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, "text"):
            yield batch.filter(pa.array(~_toxic(shared.value, batch.column("text"), threshold)[1]))

    return docs.mapInArrow(lean(run), docs.schema)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    threshold: float = THRESHOLD,
    features: int = FEATURES,
    least_docs: int = LEAST_DOCS,
    least_g: float = LEAST_G,
    counterfactual: float = COUNTERFACTUAL,
    groups=IDENTITY,
) -> DataFrame:
    """(doc_id, toxicity, toxic) for every row of ``docs``.

    ``train_rows`` bounds the labelled documents that the classifier is fitted
    on. On that sample words and stems are chosen that get a weight: those which
    ``least_docs`` documents have and whose G statistic is ``least_g`` or more,
    of these the ``features`` best, and all that name one of ``groups``; other
    words have no part in the score. ``counterfactual`` weighs the squared
    changes of scores by swaps within the sets of ``groups``.

    A text without a word that has a weight, be it null or empty, has no
    evidence: it isn't toxic, and scores a half at most. Labels that are null don't count, of labels that
    contradict each other each counts, and with one class only nothing is
    toxic. Rows with a null doc_id are scored too, repeated rows stay repeated.
    Other columns are ignored, an empty table gives no rows.
    """
    return score_documents(docs, train(docs, labels, train_rows, features, least_docs, least_g, counterfactual, groups), threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
