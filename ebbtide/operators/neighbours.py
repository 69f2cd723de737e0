"""Exact nearest neighbours and the resampling built on them.

Base rows are placed in cells around pivot rows, about as many cells as rows in a cell. A query row first searches the
nearest cell that holds enough rows, which gives a true k-th distance. Then it visits only the cells that can hold a nearer row. A
cell is cut into blocks by its rows and into slices by the queries that visit it, so a crowded one is spread. Tasks compare one
block with one slice and pass on at most ``k`` candidates per query; no list of pairs is ever formed.

Where queries would visit many cells, as in high dimensions, and in small tables, packed blocks of queries meet all packed blocks of base
rows instead: every row is written once, whatever the number of blocks it meets, and a task keeps the ``k`` best rows of its queries.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.ordering import hash_rank
from ebbtide.functions.text import hash_number, hash_token, hash_unit
from ebbtide.operators.sampling import copies_needed
from ebbtide.session import pin

BLOCK_ROWS = 4096
COMPARE = 1 << 22  # distances a task holds at a time
NO_REACH = float("inf")
PACKED_ROWS = 8192
#: Bytes of base vectors, 8 a number, that a task of packed blocks reads: it holds them in memory.
PASS_BYTES = 1 << 28
#: Up to so many pairs of rows are compared without looking for cells; above, if ``PROBES`` queries visit more than ``VISITS`` cells each.
FEW_PAIRS, PROBES, VISITS = 1 << 32, 64, 8
_ROW = "id long, vec array<double>, kinds array<long>"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by the product form and how far rounding can put each of them off."""
    own, other = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    off = (own + other) * (8 * (a.shape[1] + 4) * np.finfo(float).eps)
    return np.maximum(own + other - 2.0 * a @ b.T, 0.0), off


@dataclass(frozen=True)
class Cells:
    """Pivot rows and what lies nearest to each: number of rows, largest distance; the largest squared norm of all rows."""

    pivots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    norm: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """Distances are measured from here: a common offset costs no digits."""
        return self.pivots.mean(axis=0)

    def _steps(self, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        centre = self.centre
        step = max(1, COMPARE // len(self.pivots))
        for at in range(0, len(vectors), step):
            part = slice(at, at + step)
            yield part, *_squared(vectors[part] - centre, self.pivots - centre)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest pivot of each row, the distance to it and the squared norm."""
        cell = np.concatenate([far.argmin(1) for _, far, _ in self._steps(vectors)] or [np.zeros(0, int)])
        away = vectors - self.pivots[cell]
        return cell, np.sqrt((away * away).sum(1)), ((vectors - self.centre) ** 2).sum(1)

    def first(self, vectors: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): the nearest cell with ``wanted`` rows; every cell where none has as many."""
        enough = self.rows >= wanted
        if not enough.any():
            cells = np.flatnonzero(self.rows)
            return np.repeat(np.arange(len(vectors)), len(cells)), np.tile(cells, len(vectors))
        cell = np.concatenate([np.where(enough, far, np.inf).argmin(1) for _, far, _ in self._steps(vectors)] or [np.zeros(0, int)])
        return np.arange(len(vectors)), cell

    def others(self, vectors: np.ndarray, bound: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell): the other cells that can hold a row within ``bound`` of a query.

        A row lies within the radius of its pivot, and no nearer to any other pivot than to its own: so it is also at least as far
        away as the plane halfway between the pivots. Rounding makes both bounds smaller, never larger.
        """
        query, cell = self.first(vectors, wanted)
        queries, cells = [np.zeros(0, int)], [np.zeros(0, int)]
        slack = 8 * (vectors.shape[1] + 4) * np.finfo(float).eps
        for part, far, off in self._steps(vectors):
            reach = np.sqrt(np.maximum(far - off, 0.0)) - self.radius
            nearest = far.argmin(1)
            chosen, back = np.unique(nearest, return_inverse=True)
            apart = np.sqrt(np.maximum(_squared(self.pivots[chosen] - self.centre, self.pivots - self.centre)[0], 0.0))[back]
            spare = off + np.take_along_axis(off, nearest[:, None], 1) + 4 * slack * self.norm
            plane = (far - np.take_along_axis(far, nearest[:, None], 1) - spare) / np.maximum(2 * apart, np.finfo(float).tiny)
            plane = np.where(apart > np.sqrt(slack * self.norm), plane, 0.0)
            limit = bound[part][:, None] * (1 + slack)
            visit = (np.maximum(reach, plane * (1 - 1e-6)) <= limit) & (self.rows > 0)
            mine = (query >= part.start) & (query < part.stop)
            visit[query[mine] - part.start, cell[mine]] = False
            row, column = np.nonzero(visit)
            queries.append(row + part.start)
            cells.append(column)
        return np.concatenate(queries), np.concatenate(cells)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many category codes differ, for every pair of rows."""
    return sum(((x[:, None] != y[None, :]) for x, y in zip(a.T, b.T)), np.zeros((len(a), len(b)), dtype=int))


def _nearest_in_block(k: int, itself: bool, penalty: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest rows of one block, within its bound, for each query of one slice."""
    def compare(queries: pa.Table, block: pa.Table) -> pa.Table:
        own, other, far = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)]
        if queries.num_rows and block.num_rows:
            ids, base, kinds = block["id"].to_numpy(), _matrix(block["vec"]), _matrix(block["kinds"])
            centre = base.mean(axis=0)
            step = max(1, COMPARE // len(ids))
            for at in range(0, queries.num_rows, step):
                part = queries.slice(at, step)
                names, vectors, bound = part["id"].to_numpy(), _matrix(part["vec"]), part["bound"].to_numpy()
                rough, off = _squared(vectors - centre, base - centre)
                if penalty:
                    rough += penalty * _differing(_matrix(part["kinds"]), kinds)
                if itself:
                    rough[names[:, None] == ids[None, :]] = np.inf
                keep = min(k, rough.shape[1])
                # the product form is inexact: measure everything that may be within the limit again
                limit = np.minimum(np.partition(rough + off, keep - 1, axis=1)[:, keep - 1], bound * bound * (1 + 1e-12))
                row, column = np.nonzero((rough - off <= limit[:, None]) & np.isfinite(rough))
                exact = ((base[column] - vectors[row]) ** 2).sum(1)
                if penalty:
                    exact += penalty * (kinds[column] != _matrix(part["kinds"])[row]).sum(1)
                exact = np.sqrt(exact)
                order = np.lexsort((ids[column], exact, row))
                row, column, exact = row[order], column[order], exact[order]
                starts = np.searchsorted(row, np.arange(part.num_rows))
                best = np.arange(len(row)) - starts[row] < k
                own.append(names[row[best]])
                other.append(ids[column[best]])
                far.append(exact[best])
        return pa.table({"id": np.concatenate(own), "neighbour": np.concatenate(other), "distance": np.concatenate(far)})

    return compare


_PACKED = "block long, ids binary, known binary, vec binary, kinds binary"


def _smallest(ids: np.ndarray, known: np.ndarray, vectors: np.ndarray, kinds: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the ``k`` nearest of any row, itself left out: of equal rows those of smallest ids.

    Of rows with equal vectors, ``k + 1`` ids are enough, and ``k`` rows of each id.
    """
    whole = np.ascontiguousarray(np.concatenate([vectors + 0.0, kinds.view(np.float64)], axis=1))
    same = np.unique(whole.view(f"V{whole.shape[1] * 8}").ravel(), return_inverse=True)[1].ravel()
    if not len(same) or same.max() + 1 == len(same):
        return np.arange(len(same))
    order = np.lexsort((ids, known, same))
    same, ids, known, places = same[order], ids[order], known[order], np.arange(len(order))
    group = np.append(True, np.diff(same) != 0)
    name = group | np.append(True, (np.diff(ids) != 0) | (known[1:] != known[:-1]))
    copies = places - np.maximum.accumulate(np.where(name, places, 0))
    names = np.cumsum(name)
    names -= np.maximum.accumulate(np.where(group, names, 0))
    return np.sort(order[(copies < k) & (names <= k)])


def _packed(rows: DataFrame, size: int, k: int = 0) -> DataFrame:
    """Blocks of up to ``size`` rows, pinned; with ``k`` without the rows that equal ones of smaller id keep out of every result."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids, known = part.column("id").fill_null(0).to_numpy(), part.column("id").is_valid().to_numpy(zero_copy_only=False)
                vectors = _matrix(part.column("vec"))
                kinds = np.ascontiguousarray(_matrix(part.column("kinds")), dtype=np.int64).reshape(len(ids), -1)
                if k:
                    kept = _smallest(ids, known, vectors, kinds, k)
                    ids, known, vectors, kinds = ids[kept], known[kept], vectors[kept], kinds[kept]
                with np.errstate(over="ignore"):
                    single = vectors.astype(np.float32)
                # half the bytes where that loses nothing
                body = single if np.array_equal(single, vectors) else vectors
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, known, body, kinds)]],
                    ["block", "ids", "known", "vec", "kinds"])
                number += 1

    return pin(rows.mapInArrow(pack, _PACKED))


@dataclass(frozen=True)
class Block:
    """Rows of one packed block."""

    ids: np.ndarray
    known: np.ndarray
    vectors: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def read(ids: bytes, known: bytes, vec: bytes, kinds: bytes, numbers: int) -> Block:
        names = np.frombuffer(ids, np.int64)
        body = np.frombuffer(vec, np.float32 if len(vec) == 4 * numbers * len(names) else np.float64)
        return Block(names, np.frombuffer(known, bool), body.reshape(len(names), -1).astype(np.float64),
                     np.frombuffer(kinds, np.int64).reshape(len(names), -1))


class Nearest:
    """The ``k`` nearest rows of the queries of one block, among all blocks they have met."""

    def __init__(self, queries: Block, k: int, itself: bool, penalty: float) -> None:
        self.queries, self.k, self.itself, self.penalty = queries, k, itself, penalty
        self.far = np.full((len(queries.ids), k), np.inf)
        self.ids, self.known = np.zeros(self.far.shape, np.int64), np.zeros(self.far.shape, bool)

    def meet(self, block: Block) -> None:
        """Single precision rules out pairs, by more than its error; what is left is measured exactly."""
        here = np.isfinite(block.vectors).all(1)
        base, ids, known, kinds = block.vectors[here], block.ids[here], block.known[here], block.kinds[here]
        if not len(ids):
            return
        centre = base.mean(axis=0)
        other = base - centre
        theirs = (other * other).sum(1)
        off = 8 * (base.shape[1] + 4) * float(np.finfo(np.float32).eps)
        step = max(1, COMPARE // (4 * len(ids)))
        for at in range(0, len(self.queries.ids), step):
            part = slice(at, at + step)
            vectors = np.where(np.isfinite(self.queries.vectors[part]).all(1)[:, None], self.queries.vectors[part], np.nan)
            own = vectors - centre
            mine = (own * own).sum(1)
            scale = max(float(np.nanmax(mine, initial=0.0)), float(theirs.max())) or 1.0
            left = np.concatenate([own * (-2 / math.sqrt(scale)), np.ones((len(own), 1))], axis=1).astype(np.float32)
            right = np.concatenate([other / math.sqrt(scale), (theirs * ((1 - off) / scale))[:, None]], axis=1).astype(np.float32)
            # less than the squared distance without the query's own part
            low = left @ right.T
            if self.penalty:
                low += (self.penalty / scale) * _differing(self.queries.kinds[part], kinds).astype(np.float32)
            spare = 1e-30 + 1e-6 * self.penalty * kinds.shape[1] / scale
            limit = (self.far[part, -1] ** 2 * (1 + 1e-12) - mine * (1 - off)) / scale + spare
            open_ = np.flatnonzero(np.isinf(self.far[part, -1]) & np.isfinite(mine))
            if len(open_):
                rows = low[open_]
                if self.itself:
                    names, there = self.queries.ids[part][open_], self.queries.known[part][open_]
                    rows[(names[:, None] == ids[None, :]) & there[:, None] & known[None, :]] = np.inf
                last = np.partition(rows, min(self.k, rows.shape[1]) - 1, axis=1)[:, min(self.k, rows.shape[1]) - 1]
                limit[open_] = last.astype(float) + 4 * off * (mine[open_] + theirs.max()) / scale + 2 * spare
            limit = np.minimum(np.nextafter(limit.astype(np.float32), np.float32(np.inf)), np.finfo(np.float32).max)
            # few of many: found in the flat matrix, where that is much faster
            row, column = np.divmod(np.flatnonzero(low <= limit[:, None]), len(ids))
            row += at
            if self.itself:
                others = (self.queries.ids[row] != ids[column]) | ~self.queries.known[row] | ~known[column]
                row, column = row[others], column[others]
            self._keep(row, ids[column], known[column], self._distance(row, base, kinds, column))

    def _distance(self, row: np.ndarray, base: np.ndarray, kinds: np.ndarray, column: np.ndarray) -> np.ndarray:
        out = np.empty(len(row))
        for at in range(0, len(row), 1 << 15):
            i, j = row[at:at + (1 << 15)], column[at:at + (1 << 15)]
            exact = ((base[j] - self.queries.vectors[i]) ** 2).sum(1)
            if self.penalty:
                exact += self.penalty * (kinds[j] != self.queries.kinds[i]).sum(1)
            out[at:at + (1 << 15)] = np.sqrt(exact)
        return out

    def _keep(self, row: np.ndarray, ids: np.ndarray, known: np.ndarray, far: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        ids, known, far = (np.concatenate([x[touched].ravel(), y]) for x, y in ((self.ids, ids), (self.known, known), (self.far, far)))
        real = np.isfinite(far)
        row, ids, known, far = row[real], ids[real], known[real], far[real]
        order = np.lexsort((ids, known, far, row))
        row, ids, known, far = row[order], ids[order], known[order], far[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        at = row[best], place[best]
        self.ids[at], self.known[at], self.far[at] = ids[best], known[best], far[best]

    def found(self) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries.ids[row], mask=~self.queries.known[row]),
             pa.array(self.ids[row, place], mask=~self.known[row, place]), pa.array(self.far[row, place])],
            ["id", "neighbour", "distance"])


def _meet_all(left: DataFrame, right: DataFrame, asked: int, rows: int, numbers: int, k: int, itself: bool, block_rows: int, penalty: float) -> DataFrame:
    """At most ``k`` candidates per query and pass: every packed block of queries meets all blocks of base rows of the pass.

    ``numbers`` is the length of the vectors. Base rows are read in passes of ``PASS_BYTES``.
    """
    size = lambda n: max(1, min(PACKED_ROWS, 2 * block_rows, max(256, n // 48)))
    blocks, passes = math.ceil(asked / size(asked)), math.ceil(8 * rows * numbers / PASS_BYTES)
    own = _packed(left, size(asked)).toDF(*[f"q_{c}" for c in ("block", "ids", "known", "vec", "kinds")]).repartition(max(1, blocks))
    base = _packed(right, size(rows), k).coalesce(max(1, passes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                # a view: bytes of a batch are not copied
                own, block = ([batch.column(f"{q}{c}")[i].as_buffer() for c in ("ids", "known", "vec", "kinds")] for q in ("q_", ""))
                if best is None or batch.column("q_block")[i].as_py() != at:
                    if best is not None:
                        yield best.found()
                    at, best = batch.column("q_block")[i].as_py(), Nearest(Block.read(*own, numbers), k, itself, penalty)
                best.meet(Block.read(*block, numbers))
        if best is not None:
            yield best.found()

    return own.crossJoin(base.hint("shuffle_replicate_nl")).mapInArrow(run, "id bigint, neighbour bigint, distance double")


def _shaped(frame: DataFrame, row_id: str, vector: str, categories: Sequence[str]) -> DataFrame:
    """id, vec and kinds of the rows whose vector is whole."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    kinds = F.array(*[F.xxhash64(c) for c in categories]).cast("array<bigint>")
    return frame.select(
        F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec"), kinds.alias("kinds")
    ).where(F.col("vec").isNotNull() & whole)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


class Search:
    """The two rounds of a neighbour search over base rows that are placed once."""

    def __init__(
        self, queries: DataFrame, base: DataFrame, k: int, row_id: str, vector: str, itself: bool, block_rows: int,
        categories: Sequence[str] = (), penalty: float = 0.0, written: bool = True,
    ) -> None:
        self.left, right = _shaped(queries, row_id, vector, categories), _shaped(base, row_id, vector, categories)
        self.k, self.itself, self.block_rows, self.wanted = k, itself, block_rows, k + 1 if itself else k
        self.penalty = penalty if categories else 0.0
        rows = right.count()
        # as many pivots as rows in a cell, and below one row of numbers per cell, reach the driver
        wanted = math.ceil(math.sqrt(rows))
        drawn = right.orderBy(F.xxhash64("id"), "id").limit(2 * wanted).select("vec").collect()
        distinct = list(dict.fromkeys(tuple(r["vec"]) for r in drawn))[:wanted]
        self.empty = not distinct
        if self.empty:
            return
        cells = Cells(np.array(distinct, dtype=np.float64), np.zeros(len(distinct), int), np.zeros(len(distinct)))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, reach, norm = cells.place(_matrix(batch.column("vec")))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(reach), pa.array(norm)],
                    ["id", "vec", "kinds", "cell", "reach", "norm"])

        self.placed = right.mapInArrow(place, f"{_ROW}, cell int, reach double, norm double")
        if written:
            self.placed = pin(self.placed)
        stats = self.placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r"), F.max("norm").alias("m")).collect()
        for r in stats:
            cells.rows[r.cell], cells.radius[r.cell] = r.n, r.r * (1 + 1e-12)
        self.cells = Cells(cells.pivots, cells.rows, cells.radius, max((r.m for r in stats), default=0.0))

    def _visits(self, asked: DataFrame, route: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    query, cell = route(_matrix(batch.column("vec")), batch.column("bound").to_numpy())
                    for at in range(0, len(query), 1 << 14):
                        part = batch.take(pa.array(query[at:at + (1 << 14)]))
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array(cell[at:at + (1 << 14)].astype(np.int32))], ["id", "vec", "kinds", "bound", "cell"])

        return asked.select("id", "vec", "kinds", "bound").mapInArrow(run, f"{_ROW}, bound double, cell int")

    def first(self) -> DataFrame:
        """Every query with the cell it searches first."""
        cells, wanted = self.cells, self.wanted
        return self._visits(self.left.withColumn("bound", F.lit(NO_REACH)), lambda v, _: cells.first(v, wanted))

    def second(self, found: DataFrame) -> DataFrame:
        """Every query with the other cells that can hold a row as near as the k-th one ``found``."""
        cells, wanted = self.cells, self.wanted
        full = F.count(F.lit(1)) == self.k
        bounds = found.groupBy("id").agg(F.when(full, F.max("distance")).otherwise(F.lit(NO_REACH)).alias("bound"))
        asked = self.left.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(NO_REACH)))
        return self._visits(asked, lambda v, b: cells.others(v, b, wanted))

    def measured(self, visits: DataFrame) -> DataFrame:
        """Candidates of all visits: at most k rows per query and block, whichever cell is crowded."""
        asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        pieces = lambda n, size: max(1, math.ceil(int(n) / size))
        loads = [(c, pieces(self.cells.rows[c], self.block_rows), pieces(n, 4 * self.block_rows)) for c, n in asked.items()]
        # a row per visited cell
        loads = self.left.sparkSession.createDataFrame(loads, "cell int, blocks int, slices int")
        in_block = self.placed.join(loads, "cell").select(
            "id", "vec", "kinds", "cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        to_block = visits.join(loads, "cell").select(
            "id", "vec", "kinds", "bound", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"))
        keys = ["cell", "block", "slice"]
        return to_block.groupBy(*keys).cogroup(in_block.groupBy(*keys)).applyInArrow(
            _nearest_in_block(self.k, self.itself, self.penalty), "id bigint, neighbour bigint, distance double")

    def best(self, candidates: DataFrame) -> DataFrame:
        return _best(candidates, self.k)

    def visits(self, probes: int) -> float:
        """Cells that a query visits in the second round, on average over ``probes`` queries chosen by hash."""
        few = copy.copy(self)
        few.left = pin(self.left.orderBy(F.xxhash64("id"), "id").limit(probes))
        found = pin(few.best(few.measured(few.first())))
        return few.second(found).count() / max(1, few.left.count())


def nearest(
    queries: DataFrame, base: DataFrame, k: int, *, row_id: str, vector: str, itself: bool = False,
    block_rows: int = BLOCK_ROWS, categories: Sequence[str] = (), penalty: float = 0.0,
) -> DataFrame:
    """The ``k`` nearest base rows of every query row: id, neighbour, distance, place (1..k).

    Ties go to the smaller neighbour id. With ``itself`` a row is no neighbour of its own. Vectors that are null or
    hold null or NaN take no part. Every column of ``categories`` that differs adds ``penalty`` to the squared
    distance; null is a category. The numbers alone are never farther apart, so they still rule out cells.
    """
    left, right = _shaped(queries, row_id, vector, categories), _shaped(base, row_id, vector, categories)
    rows, numbers = right.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    asked = rows if queries is base else left.count()
    if not rows or not asked:
        return left.select(
            "id", F.lit(None).cast("bigint").alias("neighbour"), F.lit(None).cast("double").alias("distance"),
            F.lit(None).cast("int").alias("place")).where(F.lit(False))
    packed = rows * asked <= FEW_PAIRS
    if not packed:
        search = Search(queries, base, k, row_id, vector, itself, block_rows, categories, penalty, written=False)
        packed = search.visits(PROBES) > VISITS
    if packed:
        return _best(_meet_all(left, right, asked, rows, numbers, k, itself, block_rows, penalty if categories else 0.0), k)
    search.placed = pin(search.placed)
    found = pin(search.best(search.measured(search.first())))
    rest = search.measured(pin(search.second(found)))
    return search.best(found.drop("place").unionByName(rest))


def majority_share(neighbours: DataFrame, labels: DataFrame, row_id: str, label: str, minority: int, k: int) -> DataFrame:
    """Share of other-class rows among the neighbours of each row."""
    of = labels.select(F.col(row_id).alias("neighbour"), F.col(label).alias("_their"))
    return neighbours.join(of, "neighbour").groupBy("id").agg(
        (F.count_if(F.col("_their") != minority) / F.lit(float(k))).alias("majority_share"))


def adasyn_plan(rows: DataFrame, row_id: str, vector: str, label: str, minority: int, k: int = 5) -> DataFrame:
    """How many synthetic rows each minority row should seed, by its share of majority neighbours."""
    few = rows.where(F.col(label) == minority)
    shares = majority_share(nearest(few, rows, k, row_id=row_id, vector=vector, itself=True), rows, row_id, label, minority, k)
    total = shares.agg(F.sum("majority_share")).scalar()
    sizes = rows.agg(F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many"))
    wide = shares.withColumn("_total", total).withColumn("_sizes", sizes.select(F.struct("few", "many")).scalar())
    weight = F.coalesce(F.try_divide(F.col("majority_share"), F.col("_total")), F.lit(0.0))
    extra = F.greatest(F.col("_sizes.many") - F.col("_sizes.few"), F.lit(0))
    return wide.select("id", "majority_share", weight.alias("weight"), F.bround(weight * extra, 0).cast("bigint").alias("synthetic"))


def allocated(hits: DataFrame, wanted: Column, seed: str) -> DataFrame:
    """(id, hits, copies): ``wanted`` copies dealt over the rows in proportion to ``hits``, by largest remainder.

    All in whole numbers: a row gets hits * wanted div total; what is left over goes, one each, to the rows of largest remainder, of
    equal remainders to those of most hits, among rows of equal hits in pseudo-random order. The copies add up to
    ``wanted`` unless no row has a hit. There are few distinct hits: only their counts are ordered in one place.
    """
    ranked = hash_rank(hits, "id", seed, ["hits"], out="_rank")
    kinds = hits.groupBy("hits").agg(F.count(F.lit(1)).alias("_n")).withColumn("_wanted", wanted)
    total = F.sum(F.col("hits") * F.col("_n")).over(Window.partitionBy(F.lit(0)))
    kinds = kinds.withColumn("_total", total).where("_total > 0")
    kinds = kinds.withColumns({
        "_each": F.expr("hits * _wanted div _total"), "_rest": F.expr("hits * _wanted % _total")})
    given = F.sum(F.col("_each") * F.col("_n")).over(Window.partitionBy(F.lit(0)))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(F.col("_rest").desc(), F.col("hits").desc()).rowsBetween(
        Window.unboundedPreceding, -1))
    kinds = kinds.select("hits", "_each", (F.col("_wanted") - given - F.coalesce(before, F.lit(0))).alias("_left"))
    extra = (F.col("_rank") <= F.col("_left")).cast("bigint")
    return ranked.join(kinds, "hits", "left").select("id", "hits", F.coalesce(F.col("_each") + extra, F.lit(0)).alias("copies"))


def adasyn_copies(rows: DataFrame, row_id: str, vector: str, label: str, minority: int, seed: str, k: int = 5) -> DataFrame:
    """(id, hits, copies): how many synthetic rows each minority row seeds, by its neighbours of other classes.

    Together they make both classes equally large; where no minority row has such a neighbour, there are none.
    """
    few = rows.where(F.col(label) == minority)
    near = nearest(few, rows, k, row_id=row_id, vector=vector, itself=True)
    of = rows.select(F.col(row_id).alias("neighbour"), F.col(label).alias("_their"))
    hits = near.join(of, "neighbour").groupBy("id").agg(F.count_if(~F.col("_their").eqNullSafe(F.lit(minority))).alias("hits"))
    return allocated(hits, _class_gap(rows, label, minority), seed)


def _class_gap(rows: DataFrame, label: str, minority: int) -> Column:
    """How many rows the minority class lacks; null labels are no class."""
    few, many = F.count_if(F.col(label) == minority), F.count_if(F.col(label) != minority)
    return rows.agg(F.greatest(many - few, F.lit(0))).scalar()


def danger_rows(shares: DataFrame) -> DataFrame:
    """Borderline seeds: at least half, but not all, neighbours belong to the other class."""
    return shares.where((F.col("majority_share") >= 0.5) & (F.col("majority_share") < 1.0))


def _draw(seed: str, *parts: Column | str) -> Column:
    return hash_token(seed, *parts)


def interpolate(a: Column, b: Column, alpha: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + alpha * (y - x))


def _between_neighbours(
    seeded: DataFrame, start: DataFrame, few: DataFrame, row_id: str, vector: str, seed: str, k: int, categories: Sequence[str],
    penalty: float,
) -> DataFrame:
    """A row on the way from each seed (id, vec, copy) to one of its nearest minority rows, drawn by hash."""
    around = nearest(
        start, few, k, row_id=row_id, vector=vector, itself=True, categories=categories, penalty=penalty
    ).select("id", "neighbour", "place")
    around = pin(around)
    known = around.groupBy("id").agg(F.max("place").alias("found"))
    drawn = seeded.join(known, "id").withColumn(
        "place", (hash_number(_draw(seed + ":pick", "id", "copy")) % F.col("found") + 1).cast("int")).withColumn(
        "alpha", hash_unit(_draw(seed + ":alpha", "id", "copy")))
    other = few.select(F.col(row_id).alias("neighbour"), F.col(vector).cast("array<double>").alias("_other"))
    made = drawn.join(around, ["id", "place"]).join(other, "neighbour").select(
        "id", "copy", "neighbour", "alpha", interpolate(F.col("vec"), F.col("_other"), F.col("alpha")).alias("vec"))
    for c in categories:
        values = few.select(F.col(row_id).alias("neighbour"), F.col(c).alias("_v"))
        votes = around.join(values, "neighbour").groupBy("id", "_v").agg(F.count(F.lit(1)).alias("_n"))
        made = made.join(votes.groupBy("id").agg(F.min_by("_v", F.struct(-F.col("_n"), F.col("_v"))).alias(c)), "id", "left")
    return made


def _copies(rows: DataFrame, copies: Column) -> DataFrame:
    """(id, vec) once for every copy, numbered from 1."""
    return rows.select(
        "id", "vec", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest(copies, F.lit(0)))).alias("copy"), copies.alias("_copies"),
    ).where(F.col("copy") <= F.col("_copies")).drop("_copies")


def smote(
    rows: DataFrame, row_id: str, vector: str, label: str, minority: int, seed: str, k: int = 5,
    categories: Sequence[str] = (), seeds: DataFrame | None = None, penalty: float = 0.0,
) -> DataFrame:
    """Synthetic minority rows between a row and one of its ``k`` nearest minority rows.

    As many as the class sizes differ by, spread evenly over the seed rows. Categories
    take the most frequent value among the neighbours, the smallest on a tie.
    """
    few = rows.where(F.col(label) == minority)
    start = few if seeds is None else few.join(seeds.select(F.col("id").alias(row_id)), row_id, "left_semi")
    ranked = hash_rank(start.select(row_id, vector), row_id, seed, out="_rank", size_out="_size").withColumn(
        "_extra", _class_gap(rows, label, minority))
    vectors = ranked.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vec"), "_rank", "_size", "_extra")
    seeded = _copies(vectors, copies_needed(F.col("_rank"), F.col("_size"), F.col("_extra")))
    return _between_neighbours(seeded, start, few, row_id, vector, seed, k, categories, penalty)


def median_deviation(rows: DataFrame, vector: str) -> float:
    """The median, over the components of a vector column, of their standard deviation over all rows; 0 without rows."""
    both = rows.select(Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(vector).cast("array<double>"))).alias("s"))
    found = both.select("s.variance", "s.count").first()
    if not found["count"]:
        return 0.0
    # over the rows themselves, not as a sample of more
    return float(np.median(np.sqrt(found["variance"].toArray() * (found["count"] - 1) / found["count"])))


#: Fixed value: each of the two indicator columns of a differing category is off by half the median deviation.
CATEGORY_SHARE = 0.5


def smotenc(
    rows: DataFrame, row_id: str, vector: str, categories: Sequence[str], label: str, minority: int, seed: str, k: int = 5
) -> DataFrame:
    """Synthetic minority rows of numbers and categories: a differing category counts as a distance, too.

    It adds half the squared median deviation of the minority's numeric components to the squared distance. Without categories this
    is ``smote``.
    """
    deviation = median_deviation(rows.where(F.col(label) == minority), vector) if categories else 0.0
    return smote(rows, row_id, vector, label, minority, seed, k, categories, penalty=CATEGORY_SHARE * deviation ** 2)


def adasyn(
    rows: DataFrame, row_id: str, vector: str, label: str, minority: int, seed: str, k: int = 5, categories: Sequence[str] = ()
) -> DataFrame:
    """Synthetic minority rows, more of them where a row's neighbours are of other classes (``adasyn_copies``)."""
    few = rows.where(F.col(label) == minority)
    copies = pin(adasyn_copies(rows, row_id, vector, label, minority, seed, k)).where("copies > 0").select("id", "copies")
    vectors = few.select(F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).join(copies, "id")
    start = few.join(copies.select(F.col("id").alias(row_id)), row_id, "left_semi")
    return _between_neighbours(_copies(vectors, F.col("copies")), start, few, row_id, vector, seed, k, categories, 0.0)


def borderline_smote(
    rows: DataFrame, row_id: str, vector: str, label: str, minority: int, seed: str, k: int = 5, around: int = 10
) -> DataFrame:
    """Synthetic rows from the seeds in danger: at least half, but not all, of ``around`` neighbours are of other classes."""
    few = rows.where(F.col(label) == minority)
    near = nearest(few, rows, around, row_id=row_id, vector=vector, itself=True)
    seeds = pin(danger_rows(majority_share(near, rows, row_id, label, minority, around)))
    return smote(rows, row_id, vector, label, minority, seed, k, seeds=seeds)


def with_synthetic(rows: DataFrame, made: DataFrame, row_id: str, vector: str, label: str, minority: int) -> DataFrame:
    """Original and synthetic rows in one table; synthetic ids are negative, originals must not be."""
    most = made.agg(F.max("copy")).scalar()
    number = F.col("id") * (F.col("_most") + 1) + F.col("copy")
    new = made.withColumn("_most", most).select(
        (-number - 1).alias(row_id), F.col("vec").alias(vector), F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
    old = rows.select(
        F.col(row_id).cast("bigint").alias(row_id), F.col(vector).cast("array<double>").alias(vector),
        F.col(label).cast("int").alias(label), F.lit(False).alias("synthetic"))
    return old.unionByName(new)


def smote_cleaned(
    rows: DataFrame, row_id: str, vector: str, label: str, minority: int, seed: str, k: int = 5, by: str = "edited"
) -> DataFrame:
    """Oversample, then drop rows with a neighbour of the other class (``edited``) or in Tomek pairs (``tomek``)."""
    if by not in ("edited", "tomek"):
        raise ValueError(f"unknown cleaning {by!r}")
    # the enlarged table is compared with itself: written once
    full = pin(with_synthetic(rows, smote(rows, row_id, vector, label, minority, seed, k), row_id, vector, label, minority))
    return edited(full, row_id, vector, label, rule="all") if by == "edited" else without_tomek(full, row_id, vector, label)


def tomek_links(rows: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """Pairs of different classes that are each other's nearest row."""
    # read twice, by both sides of the join
    first = pin(nearest(rows, rows, 1, row_id=row_id, vector=vector, itself=True).select("id", "neighbour", "distance"))
    back = first.select(F.col("id").alias("neighbour"), F.col("neighbour").alias("id"))
    classes = rows.select(F.col(row_id).alias("id"), F.col(label).alias("label"))
    other = classes.select(F.col("id").alias("neighbour"), F.col("label").alias("other_label"))
    mutual = first.join(back, ["id", "neighbour"]).where(F.col("id") < F.col("neighbour"))
    return mutual.join(classes, "id").join(other, "neighbour").where(F.col("label") != F.col("other_label")).select(
        "id", "neighbour", "distance", "label", "other_label")


def edited(rows: DataFrame, row_id: str, vector: str, label: str, k: int = 3, rule: str = "vote") -> DataFrame:
    """Rows whose class wins the ``vote`` of their ``k`` nearest rows, or is that of ``all`` of them."""
    if rule not in ("vote", "all"):
        raise ValueError(f"unknown rule {rule!r}")
    around = nearest(rows, rows, k, row_id=row_id, vector=vector, itself=True)
    theirs = rows.select(F.col(row_id).alias("neighbour"), F.col(label).alias("_their"))
    mine = rows.select(F.col(row_id).alias("id"), F.col(label).alias("_mine"))
    votes = around.join(theirs, "neighbour").join(mine, "id").groupBy("id").agg(
        F.count_if(F.col("_their") == F.col("_mine")).alias("_same"), F.count(F.lit(1)).alias("_all"))
    wins = F.col("_same") * 2 > F.col("_all") if rule == "vote" else F.col("_same") == F.col("_all")
    kept = votes.where(wins).select(F.col("id").alias(row_id))
    return rows.join(kept, row_id, "left_semi")


def without_tomek(rows: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """Rows that are in no Tomek pair."""
    links = tomek_links(rows, row_id, vector, label)
    drop = links.select(F.explode(F.array("id", "neighbour")).alias(row_id)).distinct()
    return rows.join(drop, row_id, "left_anti")


def knn_score(
    queries: DataFrame, train: DataFrame, row_id: str, vector: str, label: str, positive: int, k: int
) -> DataFrame:
    """Distance-weighted share of positive neighbours; an exact match decides alone."""
    around = nearest(queries, train, k, row_id=row_id, vector=vector)
    votes = around.join(train.select(F.col(row_id).alias("neighbour"), (F.col(label) == positive).cast("double").alias("_y")), "neighbour")
    exact = F.col("distance") == 0
    weight = 1.0 / F.when(exact, F.lit(None)).otherwise(F.col("distance"))
    summed = votes.groupBy("id").agg(
        F.count_if(exact).alias("_hits"), F.sum(F.when(exact, F.col("_y"))).alias("_hit_y"),
        F.sum(weight * F.col("_y")).alias("_wy"), F.sum(weight).alias("_w"))
    score = F.when(F.col("_hits") > 0, F.col("_hit_y") / F.col("_hits")).otherwise(F.col("_wy") / F.col("_w"))
    return summed.select(F.col("id").alias(row_id), score.alias("score"))
