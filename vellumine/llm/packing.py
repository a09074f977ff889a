"""Vector bin packing of instruction data by the dot-product heuristic.

An example needs tokens, one segment, and loss-bearing tokens; a bin has a limit
for each. A bin is filled with the example that fits and whose needs, as shares
of the limits, have the largest dot product with what the bin has left, until
none fits. Examples are dealt to shards by a hash of the row's number, so that
rows that repeat part too; each shard is packed by one task and leaves at most
one poorly filled bin more than a single packing would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.common import batches_by_key, cut, lean, partitions, row_slices, table
from vellumine.llm.tokens import VOCABULARY, Counter

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 4096, 16, 3072
#: Examples that are packed together, about: the parameter ``shard``. More fill bins a little better and take time with the square.
SHARD = 4096

_PIECES = pa.schema([("example", pa.int64()), ("piece", pa.int64()), ("token_start", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())])
PIECES = "example long, piece long, token_start long, n_tokens long, loss_tokens long"
PACKED = "example long, piece long, token_start long, n_tokens long, loss_tokens long, bin long, slot long, bin_start long"
_PACKED = pa.schema([(x.split()[0], pa.int64()) for x in PACKED.split(", ")])


def pieces(runs: list[tuple[int, bool]], max_tokens: int, max_loss: int) -> list[tuple[int, int, int]]:
    """(first token, tokens, loss tokens): cuts an example, given as runs of (tokens, bears loss), where a limit is reached."""
    out, at, start, tokens, loss = [], 0, 0, 0, 0
    for n, bears in runs:
        while n:
            take = min(n, max_tokens - tokens, max_loss - loss if bears else n)
            if not take:
                out.append((start, tokens, loss))
                start, tokens, loss = at, 0, 0
                continue
            n, at, tokens, loss = n - take, at + take, tokens + take, loss + take * bears
    if tokens:
        out.append((start, tokens, loss))
    return out


def pack(need: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, slot) of each row of ``need``, none of which exceeds ``limits``; of equal products the first row wins."""
    n = len(need)
    bins, slots = np.empty(n, np.int64), np.empty(n, np.int64)
    share = need / np.array(limits, float)
    left = np.arange(n)
    d, f = need.T.copy(), share.T.copy()
    bin_no = -1
    alive = np.ones(n, bool)
    dead = 0
    while len(left) > dead:
        bin_no += 1
        rest = np.array(limits, np.int64)
        slot = 0
        fits = alive.copy()
        while True:
            r = rest / np.array(limits, float)
            for k in range(len(limits)):
                fits &= d[k] <= rest[k]
            score = f[0] * r[0]
            for k in range(1, len(limits)):
                score = score + f[k] * r[k]
            score[~fits] = -1
            best = int(score.argmax())
            if score[best] < 0:
                break
            bins[left[best]], slots[left[best]] = bin_no, slot
            rest = rest - d[:, best]
            slot += 1
            alive[best] = fits[best] = False
            dead += 1
        if dead * 4 > len(left):
            left, d, f = left[alive], d[:, alive], f[:, alive]
            alive, dead = np.ones(len(left), bool), 0
    return bins, slots


def _pack_shards(limits: tuple[int, int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in batches_by_key(batches, ["shard"]):
            example, piece, start, tokens, loss = (group.column(c).to_numpy() for c in _PIECES.names)
            order = np.lexsort((start, piece, example, -loss, -tokens))
            example, piece, start, tokens, loss = (x[order] for x in (example, piece, start, tokens, loss))
            b, s = pack(np.stack([tokens, np.ones(len(tokens), np.int64), loss], axis=1), limits)
            order = np.lexsort((s, b))
            example, piece, start, tokens, loss, b, s = (x[order] for x in (example, piece, start, tokens, loss, b, s))
            before = np.cumsum(tokens) - tokens
            first = np.concatenate([[True], b[1:] != b[:-1]])
            before = before - before[first][np.cumsum(first) - 1]
            shard = group.column("shard")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (example, piece, start, tokens, loss, (shard << 32) + b, s, before)], schema=_PACKED)

    return run


def pack_examples(cut_examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, shard: int = SHARD) -> DataFrame:
    """Bins for (example, piece, token_start, n_tokens, loss_tokens): bin, slot in it, and bin_start, the tokens before it there.

    Rows are numbered as they are read from the written table of pieces, and
    about ``shard`` of them are packed together; who shares a bin depends on that.
    """
    spark = cut_examples.sparkSession
    held = cut(cut_examples, "pieces")
    shards = max(1, -(-held.count() // shard))
    dealt = held.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    dealt = dealt.repartition(min(shards, partitions(spark)), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(lean(_pack_shards((max_tokens, max_segments, max_loss))), PACKED)


def _check(max_tokens: int, max_segments: int, max_loss: int) -> None:
    if min(max_tokens, max_segments, max_loss) < 1:
        raise ValueError("limits must be positive")


def pack_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, path: str = VOCABULARY) -> DataFrame:
    """Bins for documents, every token of which bears loss.

    Columns doc_id, piece, token_start, n_tokens, loss_tokens, bin, slot,
    bin_start. A text longer than a limit is cut into pieces that cover all of
    it. Null and empty texts have no tokens and no rows, rows with a null doc_id
    are left out, repeated rows are packed again. Other columns are ignored; an
    empty table gives no rows.
    """
    _check(max_tokens, max_segments, max_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in row_slices(batches, "text"):
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                rows += [(i, p, *x) for p, x in enumerate(pieces([(counter.count(t), True)], max_tokens, max_loss))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES)

    src = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return pack_examples(src.mapInArrow(lean(run), PIECES), max_tokens, max_segments, max_loss).withColumnRenamed("example", "doc_id")


def pack_conversations(turns: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, path: str = VOCABULARY) -> DataFrame:
    """Bins for conversations (conv_id, turn, role, text), of which the assistant's texts bear loss.

    Columns conv_id, piece, token_start, n_tokens, loss_tokens, bin, slot,
    bin_start. A turn is its role, a line end, its text and a line end; turns
    follow by number, then role, then a hash of the text. A conversation beyond a limit is cut
    into pieces that cover all of it. A null role or text counts as empty, a null
    turn comes first, rows with a null conv_id are left out, repeated rows are
    turns of their own. Other columns are ignored; an empty table gives no rows.
    """
    _check(max_tokens, max_segments, max_loss)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in row_slices(batches, "text"):
            role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array([counter.count(f"{r}\n") for r in role], pa.int64()), pa.array([counter.count(f"{t}\n") for t in text], pa.int64())],
                names=["conv_id", "turn", "role", "text", "head", "body"],
            )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, own in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                runs = [x for t in own for x in ((t["head"], False), (t["body"], t["role"] == "assistant"))]
                rows += [(i, p, *x) for p, x in enumerate(pieces(runs, max_tokens, max_loss))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECES)

    src = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    counted = src.mapInArrow(lean(count), "conv_id long, turn long, role string, text string, head long, body long")
    # of the text only a hash goes on: it breaks ties of turns
    slim = counted.select("conv_id", F.struct("turn", "role", F.xxhash64("text").alias("tie"), "head", "body").alias("t"))
    grouped = slim.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return pack_examples(grouped.mapInArrow(lean(build), PIECES), max_tokens, max_segments, max_loss).withColumnRenamed("example", "conv_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_conversations(table(spark, sf_dir, "conversations"))
