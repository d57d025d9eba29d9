"""Packing by non-negative least squares over a histogram of lengths.

A document is its ids and an end id. Whole windows are cut off its front; what is left, shorter than a window, is
counted in a histogram of lengths (window - 1 numbers, whatever the corpus). Combinations of up to three lengths that
fill a window, and single lengths that need no padding, are enumerated; non-negative least squares finds how often to
use each so that the histogram is met; counts are rounded up, the largest first, as far as there are remainders left for
them. What then remains is packed greedily, end to end, cut where a window is full. The last window's rest is cut into
powers of two, which need no padding.

Every remainder's place follows from its length and its rank among those of that length, so no task sees a window's
or a length's rows together: ranks are counted within a task and shifted by the counts of the tasks before it.

Cases: a null text is empty and still has its end id. Repeated rows are packed each for itself. A length that a third
of all rows share is ranked in as many tasks as hold it. An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import bpe, common

WINDOW, END_ID = 1024, 0
#: Pieces of text whose ids a worker keeps.
MEMO_ENTRIES = 200_000
#: Steps of projected gradient descent at most.
STEPS = 400
#: Whole windows of task p are numbered from (p + 1) * TASK_STRIDE; windows of remainders from 0.
TASK_STRIDE = 1 << 38


def combinations(window: int = WINDOW) -> np.ndarray:
    """Rows of three lengths, longest first, 0 for none, that fill a window or are alone a power of two."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(0, window), indexing="ij")
    c = window - a - b
    fits = (a >= b) & (b >= c) & (c >= 0) & (a < window)
    filled = np.stack([a[fits], b[fits], c[fits]], axis=1)
    alone = [(1 << k, 0, 0) for k in range(window.bit_length() - 1)]
    return np.concatenate([filled, np.array(alone).reshape(-1, 3)])


def repeat_counts(lengths: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each combination: least squares against the histogram, counts not below 0.

    Accelerated projected gradient descent; a combination touches three numbers, so a step is a few bincounts.
    """
    size = len(histogram)
    used = lengths > 0
    scale = max(1.0, float(histogram.max(initial=0)))
    target = histogram / scale
    # the gradient can't change faster than by the largest row sum of A A^T
    uses = np.bincount(lengths[used], minlength=size)
    step = 1.0 / max(1.0, 3.0 * uses.max())
    x = y = np.zeros(len(lengths))
    momentum = 1.0
    for _ in range(steps):
        fit = sum(np.bincount(lengths[:, k], y * used[:, k], size) for k in range(3))
        off = fit - target
        off[0] = 0
        gradient = off[lengths].sum(axis=1)
        new = np.maximum(y - step * gradient, 0)
        after = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
        y = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x * scale


class Plan:
    """Which combinations are used how often, and where each remainder goes by its length and rank."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        """histogram[n]: how many remainders have n ids; n below the window."""
        self.window = window
        left = histogram.astype(np.int64).copy()
        left[0] = 0
        lengths = combinations(window)
        usable = (left[lengths] > 0) | (lengths == 0)
        lengths = lengths[usable.all(axis=1)]
        chosen: list[tuple[int, tuple[int, ...]]] = []
        if len(lengths):
            wanted = repeat_counts(lengths, left.astype(float))
            for k in np.argsort(-wanted, kind="stable"):
                if wanted[k] <= 0:
                    break
                parts = [int(n) for n in lengths[k] if n]
                times = min(math.ceil(wanted[k]), *(int(left[n]) // parts.count(n) for n in set(parts)))
                if times > 0:
                    chosen.append((times, tuple(parts)))
                    for n in parts:
                        left[n] -= times
        # by length: where runs of ranks begin, and the window and offset of each run's first
        runs: dict[int, list[tuple[int, int]]] = {}
        filled = dict.fromkeys(range(window), 0)
        sequence = 0
        for times, parts in chosen:
            offset = 0
            for n in parts:
                runs.setdefault(n, []).append((filled[n], sequence, offset))
                filled[n] += times
                offset += n
            sequence += times
        self.runs = {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}
        self.packed = np.array([filled[n] for n in range(window)], np.int64)
        self.first_residual = sequence
        sizes = left * np.arange(window)
        #: where the residuals of each length begin when all lie end to end, longest first
        self.residual_at = np.concatenate([np.cumsum(sizes[::-1])[::-1][1:], [0]])
        self.residual_total = int(sizes.sum())

    def places(self, length: int, ranks: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Of each rank, its pieces: (index in ranks, start in the remainder, length, window, offset) as rows."""
        out = []
        fixed = ranks < self.packed[length]
        if fixed.any():
            begins, sequences, offsets = self.runs[length]
            run = np.searchsorted(begins, ranks[fixed], side="right") - 1
            for i, s, o in zip(np.flatnonzero(fixed), sequences[run] + ranks[fixed] - begins[run], offsets[run]):
                out.append((int(i), 0, length, int(s), int(o)))
        window, whole = self.window, self.residual_total // self.window
        for i in np.flatnonzero(~fixed):
            at, start = int(self.residual_at[length] + (ranks[i] - self.packed[length]) * length), 0
            while start < length:
                block, offset = divmod(at + start, window)
                sequence, room = self.first_residual + block, window - offset
                if block == whole:  # the last: powers of two, the largest first
                    rest, begin = self.residual_total - whole * window, 0
                    while True:
                        size = 1 << (rest.bit_length() - 1)
                        if offset < begin + size:
                            break
                        begin, rest, sequence = begin + size, rest - size, sequence + 1
                    offset, room = offset - begin, begin + size - offset
                n = min(length - start, room)
                out.append((int(i), start, n, sequence, offset))
                start += n
        return out


def _cut(docs: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each whole window of a document (length = window, ids null) and for each remainder with its ids.

    task and rank: the k-th row of this length in this task.
    """
    fields = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "doc_tokens": pa.int64(), "task": pa.int32(), "rank": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}

    def run(batches):
        codec = bpe.on_worker(bpe.FastCodec, vocabulary, MEMO_ENTRIES)
        if len(codec.strings) > 1 << 16:
            raise ValueError("ids above 65535 don't fit the 16 bits in which remainders are kept")
        task, ranks, step = TaskContext.get().partitionId(), [0] * (WINDOW + 1), 4 * WINDOW
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = codec.encode(text.as_py() or "") + END_ID.to_bytes(4, "little")
                for begin in range(0, len(ids), step):
                    piece = ids[begin : begin + step]
                    n = len(piece) // 4
                    short = np.frombuffer(piece, "<u4").astype("<u2").tobytes() if n < WINDOW else None
                    for column, value in zip(rows, (doc_id, begin // 4, n, len(ids) // 4, task, ranks[n], zlib.crc32(piece), short)):
                        column.append(value)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, fields.values())], list(fields))

    return common.mapped(common.id_and_text(docs), run, "doc_id long, start long, length int, doc_tokens long, task int, rank long, ids_crc32 long, ids binary", cached=True)


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece.

    Remainders are kept as 16-bit numbers: a vocabulary with ids above 65535 is refused.
    """
    spark = docs.sparkSession
    common.ship(spark)
    cut = common.stored(_cut(docs, vocabulary))
    counts = cut.where(F.col("length") < WINDOW).groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(WINDOW, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # below a window's number of rows
        histogram[row.length] = row.n
    plan = spark.sparkContext.broadcast(Plan(histogram))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))

    whole = cut.where(F.col("length") == WINDOW).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", ((F.col("task") + 1) * F.lit(TASK_STRIDE) + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    ranked = cut.where(F.col("length") < WINDOW).join(shifts, ["length", "task"]).select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("rank") + F.col("shift")).alias("rank"))

    def place(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        own = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            rows = []
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                rows += [(int(at[i]), start, size, sequence, offset) for i, start, size, sequence, offset in own.places(int(n), rank[at])]
            if not rows:
                continue
            index, start, size, sequence, offset = (np.array(c, np.int64) for c in zip(*rows))
            taken = pa.array(index)
            crc = batch.column("ids_crc32").take(taken).to_numpy(zero_copy_only=False).copy()
            ids = batch.column("ids")
            for k in np.flatnonzero(size < length[index]):
                piece = np.frombuffer(ids[int(index[k])].as_py(), "<u2")[start[k] : start[k] + size[k]]
                crc[k] = zlib.crc32(piece.astype("<u4").tobytes())
            begin = batch.column("start").take(taken).to_numpy(zero_copy_only=False) + start
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(taken), pa.array(begin), pa.array(size), pa.array(crc), batch.column("doc_tokens").take(taken), pa.array(sequence), pa.array(offset)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return whole.unionByName(common.mapped(ranked, place, schema))
