"""Find the keys that occur more than once in a corpus, at a few bytes a key.

A block is some thousand documents of one task. Its 56-bit keys are sorted,
equal ones combined, and shipped as packed differences to the partition that
owns their range; there the counts of all blocks are added, and only keys whose
total is at least two travel back to their block. A key that is hot in the
corpus therefore costs one entry a block, however often it occurs.
"""

from __future__ import annotations

import pickle
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import binary_views, lean, partitions

U = np.uint64
KEY_BITS = 56
MAX_COUNT = 2**32 - 1

#: Bytes of input, as the plan estimates them, for each partition of keys: its arrays stay in memory.
PART_BYTES = 16 << 20

#: A block: what its documents need later (pickled), the keys, for each key the number of the thing it came from, and a value for each of these or nothing.
Block = tuple[object, np.ndarray, np.ndarray, np.ndarray | None]

_SCHEMA = "part int, block long, head boolean, blob binary"
_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("head", pa.bool_()), ("blob", pa.binary())])


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest one needs."""
    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return struct.pack("<IB", len(x), width) + x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    n, width = struct.unpack_from("<IB", blob, at)
    at += 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel(), at + n * width


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=U(0)))


def unpack_sorted(blob: memoryview, at: int = 0) -> tuple[np.ndarray, int]:
    d, at = unpack(blob, at)
    return np.cumsum(d, dtype=U), at


def grouped(keys: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, where each starts, and refs in that order."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[start], start, np.diff(start, append=len(k)), refs[order]


def _send(make: Callable[[Iterator[pa.RecordBatch]], Iterator[Block]], parts: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for number, (extra, keys, refs, values) in enumerate(make(batches)):
            block = task + number
            key, start, count, ref = grouped(keys, refs)
            least = np.minimum.reduceat(values[ref], start) if values is not None and len(key) else None
            several = count > 1
            single = ref[start].astype(U)
            single[several] = np.arange(int(several.sum()), dtype=U)
            lists = ref[np.repeat(several, count)] if len(key) else ref[:0]
            head = pickle.dumps((extra, pack(count[several]), pack(lists)), 5)
            owner = (((key >> U(bits - 32)) * U(parts)) >> U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-2))
            rows = [(block % parts, block, True, head)]
            for lo, hi in zip(cuts, cuts[1:]):
                rows.append((int(owner[lo]), block, False, pack_sorted(key[lo:hi]) + pack(single[lo:hi]) + pack(count[lo:hi]) + (b"" if least is None else pack(least[lo:hi]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return run


def _count(parts: int, with_keys: bool, with_least: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, keys, refs, counts, leasts = [], [], [], [], []
        for batch in batches:
            block, head = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            heads = batch.filter(batch.column(2))
            if heads.num_rows:
                yield heads
            for b, h, blob in zip(block, head, binary_views(batch.column(3))):
                if not h:
                    k, at = unpack_sorted(blob)
                    r, at = unpack(blob, at)
                    c, at = unpack(blob, at)
                    if with_least:
                        leasts.append(unpack(blob, at)[0])
                    blocks.append(b)
                    keys.append(k)
                    refs.append(r.astype(np.uint32))
                    counts.append(c.astype(np.uint32))
        if not blocks:
            return
        sizes = np.array([len(k) for k in keys])
        every, local = np.concatenate(keys), np.concatenate(counts)
        keys = counts = None
        order = np.argsort(every, kind="stable")
        k = every[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        total = np.add.reduceat(local[order].astype(U), start)
        mine = np.empty(len(k), U)
        mine[order] = np.repeat(total, np.diff(start, append=len(k)))
        keep = mine > U(1)
        if with_least:
            first = np.empty(len(k), U)
            first[order] = np.repeat(np.minimum.reduceat(np.concatenate(leasts)[order], start), np.diff(start, append=len(k)))
            leasts = None
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, b in enumerate(blocks):
            lo, hi = at[i], at[i + 1]
            m = keep[lo:hi]
            if m.any():
                blob = (pack_sorted(every[lo:hi][m]) if with_keys else b"") + pack(refs[i][m]) + pack(local[lo:hi][m] > 1) + pack(np.minimum(mine[lo:hi][m], U(MAX_COUNT)))
                blob += pack(first[lo:hi][m]) if with_least else b""
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((b % parts, b, False, blob), _ARROW.types)], schema=_ARROW)

    return run


def _return(finish: Callable[..., Iterator[pa.RecordBatch]], with_keys: bool, with_least: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, bytes] = {}
        found: dict[int, list[bytes]] = defaultdict(list)
        for batch in batches:
            for b, h, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if h:
                    heads[b] = blob
                else:
                    found[b].append(blob)
        for b in sorted(heads):
            extra, sizes, lists = pickle.loads(heads.pop(b))
            sizes, lists = unpack(memoryview(sizes))[0].astype(np.int64), unpack(memoryview(lists))[0]
            ends = np.cumsum(sizes)
            ks, rs, cs, ls = [], [], [], []
            for blob in map(memoryview, found.pop(b, ())):
                k, at = unpack_sorted(blob) if with_keys else (None, 0)
                r, at = unpack(blob, at)
                k = np.zeros(len(r), U) if k is None else k
                several, at = unpack(blob, at)
                c, at = unpack(blob, at)
                least = unpack(blob, at)[0] if with_least else c
                several = several.astype(bool)
                one = ~several
                ks.append(k[one]), rs.append(r[one]), cs.append(c[one]), ls.append(least[one])
                g = r[several].astype(np.int64)
                if len(g):
                    size = sizes[g]
                    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    ks.append(np.repeat(k[several], size))
                    rs.append(lists[np.repeat(ends[g] - size, size) + within])
                    cs.append(np.repeat(c[several], size))
                    ls.append(np.repeat(least[several], size))
            cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, U)
            yield from finish(extra, cat(ks), cat(rs).astype(np.int64), cat(cs), *([cat(ls)] if with_least else []))

    return run


def repeated_keys(
    df: DataFrame,
    make: Callable[[Iterator[pa.RecordBatch]], Iterator[Block]],
    finish: Callable[..., Iterator[pa.RecordBatch]],
    schema: str,
    bits: int = KEY_BITS,
    with_keys: bool = True,
    with_least: bool = False,
) -> DataFrame:
    """``finish`` gets each block's own entries whose key occurs at least twice in all blocks.

    ``df`` must give the same rows in the same order on every retry (``pinned``).
    ``finish(extra, keys, refs, counts)``: counts are of the whole corpus, up to
    ``MAX_COUNT``. ``bits``: width of the keys that ``make`` gives. Without
    ``with_keys`` they don't travel back, and ``keys`` are zeros. With
    ``with_least`` blocks have values, and ``finish`` also gets, for each key, the
    least value in all blocks.
    """
    parts = partitions(df.sparkSession, df, PART_BYTES)
    sent = df.mapInArrow(lean(_send(make, parts, bits)), _SCHEMA)
    counted = sent.repartitionById(parts, F.col("part")).mapInArrow(lean(_count(parts, with_keys, with_least)), _SCHEMA)
    return counted.repartitionById(parts, F.col("part")).mapInArrow(lean(_return(finish, with_keys, with_least)), schema)
