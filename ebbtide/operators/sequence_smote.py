"""Synthetic minority sequences: nearest neighbours, then interpolation along a warping path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.neighbours import smote

#: Cells of cost tables that a task holds at a time.
CELLS = 1 << 22


def alignments(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last partner of every step of many pairs: the cheapest monotone alignment under squared distance.

    ``a`` is pairs x steps x channels, ``b`` likewise. The partners of a step are neighbours. All pairs advance together
    along the anti-diagonals of their cost tables, and go back together; of equally cheap ways the diagonal one is
    taken, then the one that leaves a step of ``a``.
    """
    pairs, m, n = len(a), a.shape[1], b.shape[1]
    cost = ((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(3)
    total = np.full((pairs, m + 1, n + 1), np.inf)
    total[:, 0, 0] = 0.0
    for diagonal in range(2, m + n + 1):
        i = np.arange(max(1, diagonal - n), min(m, diagonal - 1) + 1)
        j = diagonal - i
        before = np.minimum(np.minimum(total[:, i - 1, j - 1], total[:, i - 1, j]), total[:, i, j - 1])
        total[:, i, j] = cost[:, i - 1, j - 1] + before
    first, last = np.zeros((pairs, m), dtype=np.int64), np.full((pairs, m), -1)
    live, i, j = np.arange(pairs), np.full(pairs, m), np.full(pairs, n)
    while len(live):
        first[live, i - 1] = j - 1
        last[live, i - 1] = np.maximum(last[live, i - 1], j - 1)
        ways = np.stack([total[live, i - 1, j - 1], total[live, i - 1, j], total[live, i, j - 1]])
        step = ways.argmin(axis=0)
        i, j = i - (step < 2), j - (step != 1)
        going = (i > 0) & (j > 0)
        live, i, j = live[going], i[going], j[going]
    return first, last


def warping_path(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The alignment of one pair, step by step."""
    first, last = alignments(a[None], b[None])
    return [(i, j) for i, (low, high) in enumerate(zip(first[0], last[0])) for j in range(low, high + 1)]


def between_all(a: np.ndarray, b: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Sequences at ``alpha`` between pairs of others: each step moves towards its first partner.

    A step that comes out as all zero moves towards its next partner instead; one that is zero towards all of them takes the
    step before it.
    """
    first, last = alignments(a, b)
    made = np.zeros_like(a, dtype=float)
    row = np.arange(len(a))[:, None]
    for later in range(int((last - first).max(initial=0)) + 1):
        open_ = ~made.any(axis=2) & (first + later <= last)
        moved = a + alpha[:, None, None] * (b[row, np.minimum(first + later, b.shape[1] - 1)] - a)
        made = np.where(open_[:, :, None], moved, made)
    for step in range(1, made.shape[1]):
        empty = ~made[:, step].any(axis=1)
        made[empty, step] = made[empty, step - 1]
    return made


def between(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """``between_all`` for one pair."""
    return between_all(a[None], b[None], np.array([alpha]))[0]


def _stacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, sequences) of a column of steps of channels, by shape."""
    steps = column.value_lengths().to_numpy()
    inner = column.flatten()
    channels = inner.value_lengths().to_numpy()
    values = inner.flatten().to_numpy(zero_copy_only=False).astype(float)
    begin = np.append(0, np.cumsum(steps))
    edge = np.append(0, np.cumsum(channels))
    width = np.array([channels[begin[r]] if steps[r] else 0 for r in range(len(steps))])
    if any((channels[begin[r]:begin[r + 1]] != width[r]).any() for r in range(len(steps))):
        raise ValueError("the steps of a sequence have the same number of channels")
    for shape in set(zip(steps.tolist(), width.tolist())):
        rows = np.flatnonzero((steps == shape[0]) & (width == shape[1]))
        yield rows, np.stack([values[edge[begin[r]]:edge[begin[r + 1]]].reshape(shape) for r in rows])


def _nested(sequences: np.ndarray) -> pa.ListArray:
    pairs, steps, channels = sequences.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(pairs * steps + 1) * channels, pa.int32()), pa.array(sequences.ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(pairs + 1) * steps, pa.int32()), inner)


def warped(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The sequence between ``a`` and ``b`` of every row; rows of equal shapes are made together, in pieces of bounded size."""
    for rows_a, a in _stacked(batch.column("a")):
        for rows_b, b in _stacked(batch.column("b")):
            rows, at, bt = np.intersect1d(rows_a, rows_b, assume_unique=True, return_indices=True)
            step = max(1, CELLS // max(1, a.shape[1] * b.shape[1]))
            for k in range(0, len(rows), step):
                part = slice(k, k + step)
                own = batch.take(pa.array(rows[part]))
                made = between_all(a[at[part]], b[bt[part]], own.column("alpha").to_numpy())
                names = ["id", "copy", "neighbour", "alpha"]
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in names], _nested(made)], [*names, "sequence"])


def sequence_smote(rows: DataFrame, row_id: str, sequence: str, label: str, minority: int, seed: str, k: int = 5) -> DataFrame:
    """As many synthetic sequences as the classes differ by: id, copy, neighbour, alpha, sequence.

    Neighbours compare whole sequences of equal length; the pairs of an Arrow batch are warped together.
    """
    flat = rows.withColumn("_flat", F.flatten(sequence))
    drawn = smote(flat, row_id, "_flat", label, minority, seed, k).select("id", "copy", "neighbour", "alpha")
    kind = "array<array<double>>"
    own = rows.select(F.col(row_id).cast("bigint").alias("id"), F.col(sequence).cast(kind).alias("a"))
    other = rows.select(F.col(row_id).cast("bigint").alias("neighbour"), F.col(sequence).cast(kind).alias("b"))
    pairs = drawn.join(own, "id").join(other, "neighbour").select(
        F.col("id").cast("bigint").alias("id"), "copy", F.col("neighbour").cast("bigint").alias("neighbour"), "alpha", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from warped(batch)

    return pairs.mapInArrow(run, f"id bigint, copy bigint, neighbour bigint, alpha double, sequence {kind}")
