"""N-gram Jaccard self-join by T-occurrence search (DivideSkip).

1. Every document becomes the set of its word n-gram hashes. An n-gram that is
   in one document only can't be shared, so ``exchange`` first finds those in at
   least two; a document of n n-grams with fewer than ceil(t * n) such n-grams
   has no partner.
2. Documents with equal sets form a class; one set stands for it below.
3. Two sets with Jaccard >= t share one of their n - ceil(t * n) + 1 rarest
   n-grams (prefix filter). Each n-gram has a centre, the least number of a set
   that has it, and a set goes once to each centre of its prefix. So n-grams in
   the same documents bring these together once, any two sets that share a
   prefix n-gram meet, and nothing is as large as a connected component. A centre
   beyond ``MEET_UNITS`` is split by a hash; every two of its parts meet.
4. Where they meet, each set queries an inverted index: its short lists are
   merged with a skipping heap down to T - L occurrences, the L longest are only
   probed by binary search, and what reaches the overlap is a pair, once: where
   the centre is that of the rarest n-gram that both have.

No step samples, caps or cuts anything. Sets hold 56-bit hashes: two different
n-grams of two documents count as one with a chance of 2**-56.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm import words as W
from vellumine.llm.common import binary_views, cut, int_column, lean, partitions, pinned, release, row_slices, table
from vellumine.llm.components import components
from vellumine.llm.exchange import KEY_BITS, MAX_COUNT, Block, repeated_keys

U = np.uint64
#: Copies of one text that were each changed in one word of ten still share half of their 3-grams.
N_GRAM, THRESHOLD = 3, 0.5
BLOCK_GRAMS = 1 << 21
BLOCK_DOCS = 65_000
#: Sets of a centre that meet in one go; a set counts one, and one more for each ``UNIT_GRAMS`` n-grams.
MEET_UNITS, UNIT_GRAMS = 1024, 1000
#: Centres that are split, at most: with more, the parts grow instead.
SPLIT_CENTRES = 1_000_000
#: N-grams that are indexed together, of one meeting or of several small ones.
INDEX_GRAMS = 1 << 19
#: Bytes of sets for each partition of the meetings.
MEET_BYTES = 8 << 20
#: Cost of a probe against a merge step, for how many lists count as long.
MU = 0.0085
#: Entries of short lists that the heap merges; more are counted in one pass over arrays, which a heap in Python can't match.
HEAP_ENTRIES = 4096

PAIRS = "doc_id_a long, doc_id_b long, overlap long, n_a long, n_b long"
_DOCS = "doc_id long, n long, digest binary, grams binary"
_DOCS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("grams", pa.binary())])
_SETS = "digest binary, n long, copies long, grams binary, centres array<long>"
_SETS_ARROW = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary()), ("centres", pa.list_(pa.int64()))])
_PLACED = "centre long, bi int, bj int, part int, digest binary, n long, copies long, grams binary, own binary"
_PLACED_ARROW = pa.schema(
    [("centre", pa.int64()), ("bi", pa.int32()), ("bj", pa.int32()), ("part", pa.int32()), ("digest", pa.binary()), ("n", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary()), ("own", pa.binary())]
)
_LINKS = "digest binary, other binary, links long"
_MATCHES = "a binary, b binary, overlap long, n_a long, n_b long"


def required(n: int, t: Fraction) -> int:
    """Least overlap that a set of ``n`` can have with any set at Jaccard ``t``."""
    return math.ceil(t * n)


def _required(n: np.ndarray, t: Fraction) -> np.ndarray:
    return -(-n * t.numerator // t.denominator)


def gram_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, key) of each distinct n-gram; a text shorter than ``size`` words is one n-gram."""
    w = W.hash_words(text, W.word_class(W.SPACES))
    ok = W.inside(w.bounds, size)
    doc = W.word_document(w.bounds)
    keys, owner = W.window_hashes(w.hashes, size)[ok], doc[: len(ok)][ok]
    counts = np.diff(w.bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        own = np.array([W.span_hash(w.hashes[w.bounds[d] : w.bounds[d + 1]]) for d in short], U)
        keys, owner = np.concatenate([keys, own]), np.concatenate([owner, short])
    keys = keys >> U(64 - KEY_BITS)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


def _from_text(size: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        ids, ns, digests, keys, refs, docs, grams = [], [], [], [], [], 0, 0

        def block() -> Block:
            return (np.concatenate(ids), np.concatenate(ns), digests), np.concatenate(keys), np.concatenate(refs), None

        for part in row_slices(batches, "text", 2 << 20):
            values, null = int_column(part, "doc_id")
            part, values = part.filter(pa.array(~null)), values[~null]
            owner, key = gram_sets(part.column("text"), size)
            ends = np.searchsorted(owner, np.arange(len(values) + 1)).tolist()
            digests += [xxhash.xxh3_128_digest(key[a:b]) if a < b else None for a, b in zip(ends, ends[1:])]
            ids.append(values)
            ns.append(np.bincount(owner, minlength=len(values)))
            keys.append(key)
            refs.append((owner + docs).astype(np.uint32))
            docs, grams = docs + len(values), grams + len(key)
            if grams >= BLOCK_GRAMS or docs >= BLOCK_DOCS:
                yield block()
                ids, ns, digests, keys, refs, docs, grams = [], [], [], [], [], 0, 0
        if docs:
            yield block()

    return make


def _number(digest: bytes) -> int:
    return int.from_bytes(digest[:5], "little")


def _from_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    digests, ns, copies, keys, grams = [], [], [], [], 0

    def block() -> Block:
        return (digests, np.array(ns), copies), np.concatenate(keys), np.repeat(np.arange(len(ns)), [len(k) for k in keys]).astype(np.uint32), np.array([_number(d) for d in digests], U)

    for batch in batches:
        for d, n, c, blob in zip(*(batch.column(x).to_pylist() for x in ("digest", "n", "copies")), binary_views(batch.column("grams"))):
            digests.append(d), ns.append(n), copies.append(c), keys.append(np.frombuffer(blob, U))
            grams += len(keys[-1])
            if grams >= BLOCK_GRAMS or len(ns) >= BLOCK_DOCS:
                yield block()
                digests, ns, copies, keys, grams = [], [], [], [], 0
    if ns:
        yield block()


def _by_rarity(ns: np.ndarray, keys: np.ndarray, refs: np.ndarray, counts: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which documents may have a partner, the order of their shared n-grams from rare to frequent, and where each document's start."""
    ok = (ns > 0) & (np.bincount(refs, minlength=len(ns)) >= _required(ns, t))
    take = np.flatnonzero(ok[refs])
    take = take[np.lexsort((keys[take], np.minimum(counts[take], U(MAX_COUNT)), refs[take]))]
    return ok, take, np.searchsorted(refs[take], np.arange(len(ns) + 1))


def _documents(t: Fraction):
    """Every document, with its shared n-grams if it may have a partner."""

    def finish(extra, keys: np.ndarray, refs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, ns, digests = extra
        ok, order, ends = _by_rarity(ns, keys, refs, counts, t)
        keys = keys[order]
        blobs = [keys[a:b].tobytes() if o else None for o, a, b in zip(ok.tolist(), ends.tolist(), ends[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ns), pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], schema=_DOCS_ARROW)

    return finish


def _centred(t: Fraction):
    """Sets that may have a partner, with the centres of their prefix."""

    def finish(extra, keys: np.ndarray, refs: np.ndarray, counts: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        digests, ns, copies = extra
        ok, order, ends = _by_rarity(ns, keys, refs, counts, t)
        keys, least = keys[order], least[order].astype(np.int64)
        rows = []
        for i in np.flatnonzero(ok).tolist():
            a, b, n = int(ends[i]), int(ends[i + 1]), int(ns[i])
            rows.append((digests[i], n, copies[i], keys[a:b].tobytes(), least[a : b - required(n, t) + 1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), _SETS_ARROW.types)], schema=_SETS_ARROW)

    return finish


def _spread(split: dict[int, int]):
    """A row for each set and meeting: the centre, which of its parts meet, and which n-grams of the prefix are its own (bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for digest, n, copies, grams, centres in zip(*(batch.column(x).to_pylist() for x in _SETS_ARROW.names)):
                centres = np.array(centres)
                for c in np.unique(centres).tolist():
                    k = split.get(c, 1)
                    part = int.from_bytes(digest[8:], "little") % k
                    own = np.packbits(centres == c).tobytes()
                    rows += [(c, min(part, x), max(part, x), part, digest, n, copies, grams, own) for x in range(k)]
                    size += k * len(grams)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), _PLACED_ARROW.types)], schema=_PLACED_ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), _PLACED_ARROW.types)], schema=_PLACED_ARROW)

    return run


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(value, occurrences) of the values in at least ``need`` of the sorted lists; a heap of their fronts skips what can't reach it."""
    k = len(lists)
    if k < need:
        return []
    at = [0] * k
    heap = [v[0] * k + i for i, v in enumerate(lists)]
    heapq.heapify(heap)
    out = []
    pop, push = heapq.heappop, heapq.heappush
    while len(heap) >= need:
        top = heap[0] // k
        limit = (top + 1) * k
        popped = []
        while heap and heap[0] < limit:
            popped.append(pop(heap) % k)
        if len(popped) >= need:
            out.append((top, len(popped)))
            for i in popped:
                a = at[i] = at[i] + 1
                if a < len(lists[i]):
                    push(heap, lists[i][a] * k + i)
            continue
        while len(popped) < need - 1 and heap:
            popped.append(pop(heap) % k)
        if not heap:
            break
        target = heap[0] // k
        for i in popped:
            a = at[i] = bisect_left(lists[i], target, at[i])
            if a < len(lists[i]):
                push(heap, lists[i][a] * k + i)
    return out


def long_lists(need: int, longest: int, total: int) -> int:
    """How many of the longest lists are probed instead of merged."""
    return max(0, min(need - 1, total - 1, int(need / (MU * math.log2(max(2, longest)) + 1))))


class Index:
    """Sets in their meetings, ordered by meeting and size, and the inverted lists of their n-grams.

    ``part`` and ``two``: in a meeting of two parts only sets of different parts
    are compared. ``own[i]``: the positions in the prefix of set i whose n-gram
    has the meeting's centre.
    """

    def __init__(self, meeting: np.ndarray, sizes: np.ndarray, part: np.ndarray, two: np.ndarray, sets: list[np.ndarray], own: list[np.ndarray]) -> None:
        self.sizes, self.sets, self.own = sizes, sets, own
        n = self.n = len(sets)
        count = np.array([len(s) for s in sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(count)])
        distinct, gram = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), count)
        here, there = 2 * meeting + part, np.where(two, 2 * meeting + 1 - part, 2 * meeting)
        self.query = (there[owner] * len(distinct) + gram) * n
        key = (here[owner] * len(distinct) + gram) * n + owner
        self.lists = np.sort(key)
        #: sets of one meeting follow each other; the least size that can match starts at ``low``
        big = int(sizes.max()) + 1
        self.at = meeting * big
        self.ordered = self.at + sizes

    def search(self, t: Fraction) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(set, partners before it, overlaps)."""
        lows = np.searchsorted(self.ordered, self.at + _required(self.sizes, t))
        for r in range(self.n):
            low = int(lows[r])
            if low >= r:
                continue
            n, keys = int(self.sizes[r]), self.query[self.ends[r] : self.ends[r + 1]]
            need = required(n, t)
            starts, stops = np.searchsorted(self.lists, keys + low), np.searchsorted(self.lists, keys + r)
            lengths = stops - starts
            hit = np.flatnonzero(lengths)
            if len(hit) < need:
                continue
            by_length = hit[np.argsort(lengths[hit], kind="stable")]
            long = long_lists(need, int(lengths[by_length[-1]]), len(by_length))
            short, rest = by_length[: len(by_length) - long], by_length[len(by_length) - long :]
            cand, overlap = self._merged(short, starts, stops, keys, low, r, need - long)
            if not len(cand):
                continue
            if long:
                overlap = overlap + self._probed(rest, starts, stops, keys, cand, low, r)
            ok = overlap * (t.denominator + t.numerator) >= t.numerator * (n + self.sizes[cand])
            cand, overlap = cand[ok], overlap[ok]
            if len(cand):
                mine = self._first_here(r, cand, hit, starts, stops, keys)
                if mine.any():
                    yield r, cand[mine], overlap[mine]

    def _entries(self, which: np.ndarray, starts: np.ndarray, stops: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The sets in the given lists, list after list."""
        size = (stops - starts)[which]
        at = np.repeat(starts[which] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.lists[at] - np.repeat(keys[which], size)

    def _merged(self, short: np.ndarray, starts, stops, keys, low: int, r: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        if int((stops - starts)[short].sum()) <= HEAP_ENTRIES:
            found = merge_skip([(self.lists[starts[i] : stops[i]] - keys[i]).tolist() for i in short.tolist()], need)
            return np.array([c for c, _ in found], np.int64), np.array([o for _, o in found], np.int64)
        count = np.bincount(self._entries(short, starts, stops, keys) - low, minlength=r - low)
        cand = np.flatnonzero(count >= need)
        return cand + low, count[cand]

    def _probed(self, rest: np.ndarray, starts, stops, keys, cand: np.ndarray, low: int, r: int) -> np.ndarray:
        if len(cand) * len(rest) * 16 > int((stops - starts)[rest].sum()) + HEAP_ENTRIES:  # to read the lists takes fewer steps
            return np.bincount(self._entries(rest, starts, stops, keys) - low, minlength=r - low)[cand - low]
        wanted = keys[rest][:, None] + cand
        return (self.lists[np.minimum(np.searchsorted(self.lists, wanted), len(self.lists) - 1)] == wanted).sum(axis=0)

    def _first_here(self, r: int, cand: np.ndarray, hit: np.ndarray, starts, stops, keys) -> np.ndarray:
        """Whether the rarest n-gram that a partner shares has this meeting's centre; with another centre the pair is found there."""
        own = self.own[r]
        if own.all():
            return np.ones(len(cand), bool)
        mine, left = np.zeros(len(cand), bool), np.arange(len(cand))
        for i in hit[hit < len(own)].tolist():
            entries = self.lists[starts[i] : stops[i]] - keys[i]
            at = np.minimum(np.searchsorted(entries, cand[left]), len(entries) - 1)
            found = entries[at] == cand[left]
            mine[left[found]] = own[i]
            left = left[~found]
            if not len(left):
                break
        return mine


def _meetings(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[tuple[list[bytes], np.ndarray, Index]]:
    """(digests, copies, index) of whole meetings, several small ones at a time; rows come sorted by meeting."""
    held, grams, meeting = [], 0, None

    def index() -> tuple[list[bytes], np.ndarray, Index]:
        held.sort(key=lambda x: (x[0], x[4], x[3]))
        number, part, two, digests, sizes, copies, blobs, owns = zip(*held)
        sets = [np.frombuffer(b, U) for b in blobs]
        _, number = np.unique(np.array(number), return_inverse=True)
        own = [np.unpackbits(np.frombuffer(o, np.uint8), count=len(s) - required(n, t) + 1).astype(bool) for o, s, n in zip(owns, sets, sizes)]
        return digests, np.array(copies), Index(number, np.array(sizes), np.array(part), np.array(two), sets, own)

    number = 0
    for batch in batches:
        for c, bi, bj, part, digest, n, copies, blob, own in zip(*(batch.column(x).to_pylist() for x in _PLACED_ARROW.names)):
            if (c, bi, bj) != meeting:
                if grams >= INDEX_GRAMS:
                    yield index()
                    held, grams = [], 0
                meeting, number = (c, bi, bj), number + 1
            held.append((number, int(bi != bj and part == bj), bi != bj, digest, n, copies, blob, own))
            grams += len(blob) // 8
    if held:
        yield index()


def _matches(t: Fraction):
    """(digest, digest, overlap, sizes) of every pair of different sets."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("overlap", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, _, index in _meetings(batches, t):
            rows = [(digests[r], digests[c], o, int(index.sizes[r]), int(index.sizes[c])) for r, cand, overlap in index.search(t) for c, o in zip(cand.tolist(), overlap.tolist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's connected component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        if (root[a] == least).all() and (root[b] == least).all():
            return root
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]


def _linked(t: Fraction):
    """(set, one that it is connected with, documents that it has a link to) in a meeting; pairs don't leave it."""
    schema = pa.schema([("digest", pa.binary()), ("other", pa.binary()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for digests, copies, index in _meetings(batches, t):
            found = [(np.full(len(c), r), c) for r, c, _ in index.search(t)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                links = np.zeros(index.n, np.int64)
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                root, at = _roots(index.n, a, b), np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in at], pa.binary()), pa.array([digests[i] for i in root[at]], pa.binary()), pa.array(links[at])], schema=schema)

    return run


def _placed(docs: DataFrame, size: int, t: Fraction) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents with their digests, classes, sets in their meetings, the table that the last is read from)."""
    spark = docs.sparkSession
    src = pinned(docs.select(F.col("doc_id").cast("long"), "text"), "join-docs")
    first = cut(repeated_keys(src, _from_text(size), _documents(t), _DOCS), "shared-sets")
    members = cut(first.select("doc_id", "n", "digest").distinct(), "members")
    classes = members.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    sets = first.where("grams IS NOT NULL").select("digest", "n", "grams").dropDuplicates(["digest"]).join(classes, "digest").select("digest", "n", "copies", "grams")
    sets = cut(sets, "class-sets")
    release(first, src)
    centred = cut(repeated_keys(sets, _from_sets, _centred(t), _SETS, with_least=True), "centred-sets")
    release(sets)
    units = (1 + F.floor(F.length("grams") / (8 * UNIT_GRAMS))).cast("long")
    placed = centred.select(units.alias("units"), F.array_distinct("centres").alias("centres"), F.length("grams").alias("bytes"))
    total, moved = placed.agg(F.sum(F.col("units") * F.size("centres")), F.sum(F.col("bytes").cast("long") * F.size("centres"))).first()
    # at most SPLIT_CENTRES centres can have more than ``limit``, so the list of them is bounded
    limit = max(MEET_UNITS, -(-(total or 0) // SPLIT_CENTRES))
    large = placed.select(F.explode("centres").alias("centre"), "units").groupBy("centre").agg(F.sum("units").alias("units")).where(F.col("units") > limit).toArrow()
    split = {c: -(-u // limit) for c, u in zip(large.column(0).to_pylist(), large.column(1).to_pylist())}
    parts = max(partitions(spark), -(-(moved or 0) // MEET_BYTES))
    together = centred.mapInArrow(lean(_spread(split)), _PLACED).repartition(parts, "centre", "bi", "bj").sortWithinPartitions("centre", "bi", "bj")
    return members, classes, together, centred


def ngram_jaccard_join(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents whose sets of word n-grams have a Jaccard similarity of ``threshold`` or more.

    Columns doc_id_a <= doc_id_b, overlap, n_a, n_b, jaccard. Documents with the
    *same* set form a class: each member is paired with the least id of its
    class, and classes are paired through their least ids, so that thousands of
    copies give thousands of rows and every pair still follows from the rows.

    Words are runs of other than ASCII white space, in lower case. A text with
    fewer than ``n`` words is one n-gram of all of them; a null, empty or blank
    text has none and no partner. Rows with a null doc_id are left out, repeated
    rows count once. Rows with one doc_id and different sets are documents of
    their own, and only such can make a pair of equal ids. Other columns than
    doc_id and text are ignored. Empty tables give no rows.
    """
    t = Fraction(str(threshold))
    members, classes, together, _ = _placed(docs, n, t)
    copies = members.join(classes, "digest").where("doc_id <> least").select(F.col("least").alias("doc_id_a"), F.col("doc_id").alias("doc_id_b"), F.col("n").alias("overlap"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    of = classes.select(F.col("digest"), "least")
    found = together.mapInArrow(lean(_matches(t)), _MATCHES)
    found = found.join(of.select(F.col("digest").alias("a"), F.col("least").alias("la")), "a").join(of.select(F.col("digest").alias("b"), F.col("least").alias("lb")), "b")
    turn = F.col("la") > F.col("lb")
    either = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    pairs = found.select(either("la", "lb").alias("doc_id_a"), either("lb", "la").alias("doc_id_b"), "overlap", either("n_a", "n_b").alias("n_a"), either("n_b", "n_a").alias("n_b"))
    return pairs.unionByName(copies).withColumn("jaccard", F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def duplicate_classes(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The join of ``ngram_jaccard_join`` by document: doc_id, class_id, n_links.

    A link is a pair of that join with classes of equal sets written out: n_links
    counts the other documents whose set reaches ``threshold``, equal sets among
    them. class_id is the least doc_id that links lead to, over any number of
    them. A document is a doc_id with its set: repeated rows are one, rows with
    one doc_id and different sets are several. A null, empty or blank text has no
    links and is a class of its own. Rows with a null doc_id are left out, other
    columns are ignored, an empty table gives no rows.
    """
    t = Fraction(str(threshold))
    members, classes, together, centred = _placed(docs, n, t)
    found = cut(together.mapInArrow(lean(_linked(t)), _LINKS), "links")
    release(centred)
    label = components(found.select(F.col("digest").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    known = classes.join(links, "digest", "left").join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    known = cut(known, "classes")
    release(found)
    least = known.groupBy("label").agg(F.min("least").alias("class_id"))
    known = known.join(least, "label").select("digest", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return members.join(known, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_classes(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \t\n\r\f\v]+') AS w FROM documents WHERE doc_id IS NOT NULL
), grams AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {N_GRAM}
    THEN list_transform(range(1, len(w) - {N_GRAM} + 2), lambda i: array_to_string(w[i:i + {N_GRAM} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
  FROM words
), sets AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY g) AS s, g, len(g) AS n, min(doc_id) AS least, count(*) AS copies FROM grams WHERE len(g) > 0 GROUP BY g
), flat AS (
  SELECT s, n, copies, unnest(g) AS gram FROM sets
), pairs AS MATERIALIZED (
  SELECT a.s, b.s AS o, any_value(b.copies) AS copies FROM flat a JOIN flat b ON a.gram = b.gram AND a.s <> b.s
  GROUP BY a.s, b.s HAVING count(*) * 10 >= {round(THRESHOLD * 10)} * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT s, s AS o FROM sets UNION SELECT reach.s, pairs.o FROM reach JOIN pairs ON reach.o = pairs.s
), classes AS (
  SELECT reach.s, min(sets.least) AS class_id FROM reach JOIN sets ON sets.s = reach.o GROUP BY reach.s
), links AS (
  SELECT s, sum(copies) AS n FROM pairs GROUP BY s
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(sets.copies - 1 + coalesce(links.n, 0), 0) AS BIGINT) AS n_links
FROM grams LEFT JOIN sets USING (g) LEFT JOIN classes USING (s) LEFT JOIN links USING (s)
"""
