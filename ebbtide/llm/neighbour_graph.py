"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph holds the nearest known vectors of every vector. It starts from small groups around sampled pivots and improves in
rounds of joins: two vectors that meet in the list of a third one, or list it, are compared. Inside the rounds a vector is a code of
a byte per component around its pivot; the answers are measured on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ebbtide.llm.blocks import parts_of
from ebbtide.llm.kernels import bytes_of, mix, spread
from ebbtide.session import pin

#: Rows compared with each other in the beginning, and pivots of one set at most.
GROUP, MOST_PIVOTS = 512, 1024
#: Candidates held by a task before it passes on the best of each vector.
HELD = 1 << 20
#: Nodes and queries of a task: a small table is not dealt into more tasks than it needs, whatever the shuffle partitions.
NODES, QUERIES = 512, 16
GRAPH = ("node long, code binary, kth double, ids array<long>, far array<float>, fresh binary, "
         "drawn array<long>, old array<long>, changed int")


@dataclass(frozen=True)
class Settings:
    """Neighbours per list, new and old ones compared per round and side, pivot sets, rows per pivot, beam and its step.

    The groups of one set do not meet; the other sets join them, so there are at least two.
    """

    lists: int = 32
    sample: int = 12
    sets: int = 4
    per_pivot: int = 256
    beam: int = 224
    step: int = 48
    rounds: int | None = None
    enough: float = 0.02

    def __post_init__(self) -> None:
        if self.sets < 2:
            raise ValueError("groups of a single set of pivots never meet")


class Codes:
    """Vectors as pivot number, scale and a byte per component, for vectors of the pivots' dimension."""

    def __init__(self, pivots: dict[int, np.ndarray]) -> None:
        self.pivots = pivots

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The nearest pivot of every vector, and the codes."""
        dim = vectors.shape[1]
        pivots = self.pivots.get(dim, np.zeros((1, dim)))
        cell = nearest_row(vectors, pivots)
        rest = vectors - pivots[cell]
        scale = np.abs(rest).max(axis=1) / 127
        small = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
        head = np.empty(len(vectors), dtype=[("cell", "<i4"), ("scale", "<f8")])
        head["cell"], head["scale"] = cell, scale
        return cell, [h.tobytes() + c.tobytes() for h, c in zip(head, small)]

    def decode(self, codes: Sequence[bytes]) -> np.ndarray:
        """The vectors of codes of one dimension."""
        table = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        cell, scale = table[:, :4].copy().view("<i4")[:, 0], table[:, 4:12].copy().view("<f8")
        pivots = self.pivots.get(table.shape[1] - 12)
        rest = table[:, 12:].view(np.int8) * scale
        return rest if pivots is None else rest + pivots[cell]


def nearest_row(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    size = (rows * rows).sum(axis=1)
    steps = range(0, len(vectors), 4096)
    return np.concatenate([(size - 2 * vectors[a:a + 4096] @ rows.T).argmin(axis=1) for a in steps] or [np.zeros(0, int)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices, shifted to the first row to lose no digits to a common offset."""
    a, b = a - a[0], b - a[0]
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0)


def best_of_rows(row: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` nearest distinct ids of every row; of equal ids the first place counts."""
    order = np.lexsort((ids, row))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(row[order]) != 0) | (np.diff(ids[order]) != 0)
    places = order[first]
    places = places[np.lexsort((ids[places], far[places], row[places]))]
    return places[spread(np.bincount(row[places])) < k] if len(places) else places


def _fixed(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A column of equally long lists or binary values as a matrix."""
    values = bytes_of(column)[0].view(kind) if pa.types.is_binary(column.type) else column.flatten().to_numpy()
    return values.reshape(len(column), width)


def _lists(rows: np.ndarray, marked: np.ndarray | None = None) -> pa.Array:
    """The rows of a matrix, or their marked places, as lists."""
    marked = np.ones(rows.shape, dtype=bool) if marked is None else marked
    cuts = np.append(0, np.cumsum(marked.sum(axis=1))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(rows[marked]))


def _tasks(count: int, each: int) -> int:
    return max(1, math.ceil(count / each))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def good_vectors(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, str]:
    """Distinct (vec_id, raw): ids and the bytes of vectors that are not null, zero or empty and hold only finite numbers; and their type."""
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    number = lambda x: x.cast("double")
    good = vectors.where(
        F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & F.exists(vector, lambda x: number(x) != 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    ).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            # adding zero turns -0.0 into 0.0: equal vectors get equal bytes
            values = lists.flatten().to_numpy() + np.float32(0) if single else lists.flatten().to_numpy() + 0.0
            cuts = np.append(0, np.cumsum(lists.value_lengths().to_numpy())) * values.itemsize
            data = values.tobytes()
            raw = [data[a:b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "raw"])

    return good.mapInArrow(pack, "vec_id long, raw binary").distinct(), "<f4" if single else "<f8"


def _by_length(raws: Sequence[bytes]) -> Iterator[np.ndarray]:
    """Places of equally long values."""
    size = np.array([len(r) for r in raws])
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _sampled(ids: np.ndarray, nodes: np.ndarray, fresh: np.ndarray, turn: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``count`` fresh and as many old list places of every node, drawn by hash: marks of both."""
    key = mix(ids.astype(np.uint64) ^ mix(nodes.astype(np.uint64) + np.uint64(turn))[:, None]) >> np.uint64(2)
    out = []
    for wanted in (fresh & (ids >= 0), ~fresh & (ids >= 0)):
        ranked = np.where(wanted, key, np.uint64(2**63)).argsort(axis=1).argsort(axis=1)
        out.append(wanted & (ranked < count))
    return out[0], out[1]


def _first_lists(points: DataFrame, codes: Codes, sets: list[Codes], kind: str, use: Settings, tasks: int) -> DataFrame:
    """The graph of the groups around the pivots of every set: each vector's nearest ones in its groups."""
    k = use.lists

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, nodes = batch.column("raw").to_pylist(), batch.column("node").to_numpy()
            for at in _by_length(raws):
                vectors = np.frombuffer(b"".join(raws[i] for i in at), kind).reshape(len(at), -1).astype(float)
                code = pa.array(codes.encode(vectors)[1], pa.binary())
                for number, other in enumerate(sets):
                    cell = nearest_row(vectors, other.pivots.get(vectors.shape[1], np.zeros((1, vectors.shape[1]))))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(nodes[at]), code, pa.array(np.full(len(at), number, np.int32)),
                        pa.array(np.full(len(at), vectors.shape[1], np.int32)), pa.array(cell.astype(np.int32)),
                    ], ["node", "code", "number", "dim", "cell"])

    def compared(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        far = squared(*[codes.decode(table["code"].to_pylist())] * 2)
        np.fill_diagonal(far, np.inf)
        near = far.argsort(axis=1)[:, :min(k, len(nodes) - 1)]
        row = np.repeat(np.arange(len(nodes)), near.shape[1])
        return pa.table({
            "node": nodes, "ids": [nodes[n].tobytes() for n in near],
            "far": [far[i, n].astype("<f4").tobytes() for i, n in enumerate(near)],
        }) if len(row) else pa.table({"node": nodes, "ids": [b""] * len(nodes), "far": [b""] * len(nodes)})

    cells = pin(points.coalesce(tasks).mapInArrow(placed, "node long, code binary, number int, dim int, cell int"))
    key = ["number", "dim", "cell"]
    loads = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / F.lit(float(GROUP))).cast("int").alias("pieces"))
    # a crowded cell is dealt into pieces: groups stay small, the rounds join what the pieces part
    dealt = cells.join(loads, key).withColumn("piece", F.pmod(F.xxhash64("node", "number"), "pieces").cast("int"))
    lists = dealt.groupBy(*key, "piece").applyInArrow(compared, "node long, ids binary, far binary")
    own = cells.where("number = 0").select("node", "code")
    # a list per set comes together here
    known = lists.groupBy("node").agg(F.collect_list("ids").alias("found"), F.collect_list("far").alias("measured"))
    start = own.join(known, "node").withColumns({
        "ids": F.lit(None).cast("array<long>"), "far": F.lit(None).cast("array<float>"), "fresh": F.lit(None).cast("binary")})
    return pin(_updated(start, use, 1, tasks))


def _updated(rows: DataFrame, use: Settings, turn: int, tasks: int) -> DataFrame:
    """Lists joined with the found candidates, and the members drawn for the coming turn, which are no longer fresh."""
    k = use.lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, nodes = batch.num_rows, batch.column("node").to_numpy()
            if batch.column("ids").null_count:
                ids, far, fresh = np.full((n, k), -1), np.full((n, k), np.inf, "<f4"), np.zeros((n, k), bool)
            else:
                ids, far, fresh = (_fixed(batch.column(c), t, k) for c, t in (("ids", "<i8"), ("far", "<f4"), ("fresh", "?")))
            found = [b"".join(x or ()) for x in batch.column("found").to_pylist()]
            count = np.array([len(x) // 8 for x in found])
            row = np.concatenate([np.repeat(np.arange(n), k), np.repeat(np.arange(n), count)])
            new_ids = np.frombuffer(b"".join(found), "<i8")
            new_far = np.frombuffer(b"".join(b"".join(x or ()) for x in batch.column("measured").to_pylist()), "<f4")
            all_ids, all_far = np.concatenate([ids.ravel(), new_ids]), np.concatenate([far.ravel(), new_far])
            all_fresh = np.concatenate([fresh.ravel(), np.ones(len(new_ids), bool)])
            real = np.flatnonzero(all_ids >= 0)
            best = real[best_of_rows(row[real], all_ids[real], all_far[real], k)]
            line, place = row[best], spread(np.bincount(row[best], minlength=n))
            ids, far, fresh = np.full((n, k), -1, "<i8"), np.full((n, k), np.inf, "<f4"), np.zeros((n, k), bool)
            ids[line, place], far[line, place], fresh[line, place] = all_ids[best], all_far[best], all_fresh[best]
            changed = np.bincount(line[best >= n * k], minlength=n)
            drawn, old = _sampled(ids, nodes, fresh, turn, use.sample)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("code"), pa.array(far[:, -1].astype(float)), _lists(ids), _lists(far),
                _binary(fresh & ~drawn), _lists(ids, drawn), _lists(ids, old), pa.array(changed.astype(np.int32)),
            ], ["node", "code", "kth", "ids", "far", "fresh", "drawn", "old", "changed"])

    return rows.select("node", "code", "ids", "far", "fresh", "found", "measured").coalesce(tasks).mapInArrow(run, GRAPH)


def _meetings(graph: DataFrame, use: Settings, turn: int) -> DataFrame:
    """(at, who, fresh): the drawn members of the list of ``at``, and drawn vectors that list it."""
    def marked(column: str, fresh: bool) -> Column:
        return F.transform(column, lambda x: F.struct(x.alias("other"), F.lit(fresh).alias("fresh")))

    members = F.explode(F.concat(marked("drawn", True), marked("old", False)))
    drawn = graph.select("node", members.alias("m")).select("node", "m.other", "m.fresh")
    # a vector in very many lists hears of a drawn part of them only
    some = Window.partitionBy("at", "fresh").orderBy(F.xxhash64("who", "at", F.lit(turn)), "who")
    back = drawn.select(F.col("other").alias("at"), F.col("node").alias("who"), "fresh")
    back = back.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= use.sample)
    own = drawn.select(F.col("node").alias("at"), F.col("other").alias("who"), "fresh")
    return own.unionByName(back.select("at", "who", "fresh"))


def _compared(meetings: DataFrame, codes: Codes, use: Settings, tasks: int) -> DataFrame:
    """(node, found, measured): who met whom nearer than the last of its list, joined per task."""
    k = use.lists

    def best(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, ids, far = (np.concatenate(c) for c in zip(*held))
        names, row = np.unique(node, return_inverse=True)
        places = best_of_rows(row, ids, far, k)
        edge = np.append(0, np.cumsum(np.bincount(row[places], minlength=len(names))))
        ids, far = ids[places], far[places].astype("<f4")
        yield pa.RecordBatch.from_arrays([
            pa.array(names), pa.array([ids[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
            pa.array([far[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
        ], ["node", "found", "measured"])

    def meet(who: np.ndarray, fresh: np.ndarray, kth: np.ndarray, code: list[bytes]) -> Iterator[tuple]:
        # once each, a fresh meeting before an old one
        who, place = np.unique(who[np.argsort(~fresh, kind="stable")], return_index=True)
        place = np.argsort(~fresh, kind="stable")[place]
        order = np.argsort(~fresh[place], kind="stable")
        who, place = who[order], place[order]
        new = int(fresh[place].sum())
        if not new or len(who) < 2:
            return
        vectors, kth = codes.decode([code[i] for i in place]), kth[place]
        far = squared(vectors[:new], vectors)
        far[np.arange(new), np.arange(new)] = np.inf
        a, b = np.nonzero(far < kth[:new, None])
        yield who[a], who[b], far[a, b]
        # pairs of two fresh ones have been met from both sides
        a, b = np.nonzero(far[:, new:] < kth[None, new:])
        yield who[new + b], who[a], far[a, new + b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for at, fresh, who, kth, code in _groups(batches, "at", ("fresh", "who", "kth", "code")):
            for found in meet(who, fresh, kth, code):
                held.append(found)
                size += len(found[0])
            if size > HELD:
                yield from best(held)
                held, size = [], 0
        if size:
            yield from best(held)

    parts = parts_of(meetings)
    dealt = meetings.select("at", "fresh", "who", "kth", "code").repartition(parts, "at").coalesce(tasks)
    return dealt.sortWithinPartitions("at").mapInArrow(run, "node long, found binary, measured binary").groupBy("node").agg(
        # at most a list per task comes together here
        F.collect_list("found").alias("found"), F.collect_list("measured").alias("measured"))


def _groups(batches: Iterator[pa.RecordBatch], key: str, names: Sequence[str]) -> Iterator[tuple]:
    """(key, columns) of the groups of rows sorted by ``key``; code columns as lists, others as arrays."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        keys = table[key].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist()]
        yield from _slices(table, keys, edges, names)
        rest = table.slice(edges[-1]) if table.num_rows else None
    if rest is not None and rest.num_rows:
        yield from _slices(rest, rest[key].to_numpy(), [0, rest.num_rows], names)


def _slices(table: pa.Table, keys: np.ndarray, edges: list[int], names: Sequence[str]) -> Iterator[tuple]:
    columns = [table[n].to_pylist() if pa.types.is_binary(table[n].type) else table[n].to_numpy() for n in names]
    for a, b in zip(edges, edges[1:]):
        yield keys[a], *(c[a:b] for c in columns)


def neighbour_graph(points: DataFrame, codes: Codes, sets: list[Codes], kind: str, use: Settings, rounds: int, tasks: int) -> DataFrame:
    """NN-descent over (node, raw): the rows of ``GRAPH``, lists of ids and squared distances by distance, -1 where none."""
    graph = _first_lists(points, codes, sets, kind, use, tasks)
    for turn in range(1, rounds + 1):
        known = graph.select(F.col("node").alias("who"), "code", "kth")
        met = _compared(_meetings(graph, use, turn).join(known, "who"), codes, use, tasks)
        graph = pin(_updated(graph.select("node", "code", "ids", "far", "fresh").join(met, "node", "left"), use, turn + 1, tasks))
        if turn == rounds:
            break
        moved, size = graph.agg(F.sum("changed"), F.count(F.lit(1))).first()
        if (moved or 0) <= use.enough * size * use.lists:
            break
    return graph


def _paths(graph: DataFrame, use: Settings) -> DataFrame:
    """(node, next): a node's list and up to as many of the nearest nodes that list it."""
    listed = graph.select("node", F.explode(F.arrays_zip("ids", "far")).alias("m")).where("m.ids >= 0")
    edges = listed.select(F.col("m.ids").alias("node"), F.col("node").alias("other"), "m.far")
    near = Window.partitionBy("node").orderBy("far", "other")
    back = edges.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= use.lists)
    met = graph.select("node", "ids").join(back.groupBy("node").agg(F.collect_list("other").alias("back")), "node", "left")
    return met.select("node", F.array_union(_real("ids"), F.coalesce("back", _no_ids())).alias("next"))


def _real(ids: str) -> Column:
    return F.filter(ids, lambda x: x >= 0)


def _no_ids() -> Column:
    return F.array().cast("array<long>")


STATE = "query long, code binary, ids array<long>, far array<double>, opened array<boolean>, seen array<long>, step array<long>"


def _searched(queries: DataFrame, graph: DataFrame, codes: Codes, use: Settings, tasks: int, each: int) -> DataFrame:
    """(query, ids): the beam of every query node after a greedy search of the graph from the node itself and its list.

    Every round opens the nearest unopened nodes of each beam, measures the nodes they lead to that the query has not seen, and
    keeps the nearest ones. A query ends when its beam is open. ``tasks`` hold the graph, ``each`` the queries.
    """
    known = graph.select("node", "code")
    paths = pin(_paths(graph, use).coalesce(tasks))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.select(["code", "ids", "far", "opened", "step", "nodes", "codes"]).to_pylist():
                ids, far, opened = (np.array(r[c], t) for c, t in (("ids", "<i8"), ("far", "<f8"), ("opened", "?")))
                opened = opened | np.isin(ids, r["step"])
                if r["nodes"]:
                    new = np.array(r["nodes"], "<i8")
                    away = squared(codes.decode([r["code"]]), codes.decode(r["codes"]))[0]
                    ids, far = np.concatenate([ids, new]), np.concatenate([far, away])
                    opened = np.concatenate([opened, np.zeros(len(new), bool)])
                    keep = np.lexsort((ids, far))[:use.beam]
                    ids, far, opened = ids[keep], far[keep], opened[keep]
                rows.append((ids, far, opened, ids[~opened][:use.step]))
            types = (pa.int64(), pa.float64(), pa.bool_(), pa.int64())
            ids, far, opened, step = (pa.array(c, pa.list_(t)) for c, t in zip(zip(*rows), types))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query"), batch.column("code"), ids, far, opened, batch.column("seen"), step],
                ["query", "code", "ids", "far", "opened", "seen", "step"])

    # the list of a query's node is measured already
    own = graph.join(queries.select("node").distinct(), "node").select(
        F.col("node").alias("query"), "code", F.concat(F.array("node"), _real("ids")).alias("ids"),
        F.concat(F.array(F.lit(0.0)), F.col("far").cast("array<double>")).alias("far"))
    start = own.select(
        "query", "code", F.slice("ids", 1, use.beam).alias("ids"),
        F.slice("far", F.lit(1), F.least(F.size("ids"), F.lit(use.beam))).alias("far"),
        F.transform(F.slice("ids", 1, use.beam), lambda x: F.lit(False)).alias("opened"), F.col("ids").alias("seen"),
        F.slice("ids", 1, min(use.beam, use.step)).alias("step"))
    live, ended = pin(start.coalesce(each)), []
    while True:
        steps = live.select("query", F.explode("step").alias("node")).join(paths, "node")
        lists = steps.groupBy("query").agg(F.flatten(F.collect_list("next")).alias("reached"))
        new = live.select("query", "seen").join(lists, "query").select("query", F.explode(F.array_except("reached", "seen")).alias("node"))
        met = new.join(known, "node").groupBy("query").agg(
            F.collect_list(F.struct("node", "code")).alias("_met")
        ).select("query", F.col("_met.node").alias("nodes"), F.col("_met.code").alias("codes"))
        told = live.join(met, "query", "left").withColumn("seen", F.concat("seen", F.coalesce("nodes", _no_ids())))
        state = pin(told.coalesce(each).mapInArrow(moved, STATE))
        ended.append(state.where(F.size("step") == 0).select("query", "ids"))
        live = state.where(F.size("step") > 0)
        if live.isEmpty():
            break
    found = ended[0]
    for other in ended[1:]:
        found = found.unionByName(other)
    return found


def nearest_found(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100,
    use: Settings = Settings(),
) -> DataFrame:
    """The ``k`` nearest rows found for every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    The score is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. A row's own id is
    no candidate. Rows without id and vectors that are null, empty, zero or hold null or non-finite components take no part;
    vectors of different length are never compared. Repeated rows count once; rows of one id with different vectors are
    searched, and found, each. Every row is indexed: equal vectors share a node of the graph, which answers with their ids.

    Pivots are a sample of at most ``sets`` x ``MOST_PIVOTS`` vectors, chosen by hash, on the driver. The rounds end when few lists
    change, after a number that grows with the logarithm of the rows at the latest. A node's lists are of fixed length, what a
    task holds is bounded, and each search sees a beam: the work grows in proportion to the rows.
    """
    rows, kind = good_vectors(vectors, vec_id, vector)
    rows = pin(rows)
    # of equal vectors the k + 1 smallest ids can be in an answer
    small = Window.partitionBy("raw").orderBy("vec_id")
    few = rows.withColumn("_n", F.row_number().over(small)).where(F.col("_n") <= k + 1)
    classes = few.groupBy("raw").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    points = pin(classes.withColumn("node", F.monotonically_increasing_id()))
    count = points.count()
    per_set = max(1, min(MOST_PIVOTS, count // use.per_pivot))
    chosen = points.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(per_set * use.sets).collect()
    sets = [_pivots([r.raw for r in chosen[n::use.sets]], kind) for n in range(use.sets)]
    rounds = use.rounds or max(4, math.ceil(math.log2(count + 1) / 3))
    tasks = _tasks(count, NODES)
    graph = neighbour_graph(points.select("node", "raw"), sets[0], sets, kind, use, rounds, tasks)

    asked = rows.where(F.col("vec_id") % every == 0).join(points.select("raw", "node"), "raw")
    asked = pin(asked.select(F.col("vec_id").alias("query_id"), "node", "raw"))
    each = _tasks(asked.count(), QUERIES)
    beams = _searched(asked, graph, sets[0], use, tasks, each)
    return _measured(asked, beams, points, kind, k, each)


def _pivots(raws: Sequence[bytes], kind: str) -> Codes:
    made: dict[int, list[np.ndarray]] = {}
    for raw in raws:
        vector = np.frombuffer(raw, kind).astype(float)
        made.setdefault(len(vector), []).append(vector)
    return Codes({dim: np.stack(v) for dim, v in made.items()})


def _measured(asked: DataFrame, beams: DataFrame, points: DataFrame, kind: str, k: int, each: int) -> DataFrame:
    """The nearest rows of each query's beam by the original vectors."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = np.frombuffer(r["own"], kind).astype(float)
                others = np.stack([np.frombuffer(x["raw"], kind) for x in r["beam"]]).astype(float)
                far = np.sqrt(((others - own) ** 2).sum(axis=1))
                pairs = sorted((d, m) for d, x in zip(far.tolist(), r["beam"]) for m in x["members"])
                out.append((r["query"], [m for _, m in pairs[:2 * k + 2]], [d for d, _ in pairs[:2 * k + 2]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "ids", "far"])

    pairs = beams.select("query", F.explode("ids").alias("node"))
    met = pairs.join(points, "node").groupBy("query").agg(F.collect_list(F.struct("raw", "members")).alias("beam"))
    own = asked.groupBy("node").agg(F.first("raw").alias("own")).withColumnRenamed("node", "query")
    answers = met.join(own, "query").coalesce(each).mapInArrow(answer, "node long, ids array<long>, far array<double>")

    def others(q: Column) -> Column:
        pairs = F.arrays_zip(F.col("ids").alias("ids"), F.col("far").alias("far"))
        return F.slice(F.filter(pairs, lambda p: p["ids"] != q), 1, k)

    listed = asked.select("query_id", "node").join(answers, "node").select("query_id", F.posexplode(others(F.col("query_id"))).alias("at", "p"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.ids").alias("vec_id"), F.col("p.far").alias("score"))
