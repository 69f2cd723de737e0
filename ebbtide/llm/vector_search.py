"""Exact top-k search by inner product with ball trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.blocks import parts_of
from ebbtide.session import pin

LEAF = 128
#: Vectors in a shard, and queries in a block.
SHARD, QUERY_BLOCK = 8192, 1024


@dataclass
class BallTree:
    """Nodes as arrays: centre, radius, child numbers (-1 at leaves) and the rows [begin, end) of ``order``."""

    points: np.ndarray
    order: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    children: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> BallTree:
        """Nodes in double precision; the leaves keep the values as they are."""
        points = values.astype(float)
        order = np.arange(len(points))
        centres, radii, children, begin, end = [], [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[order[a:b]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            number = len(begin)
            centres.append(centre)
            radii.append(np.sqrt(away.max()))
            children.append([-1, -1])
            begin.append(a)
            end.append(b)
            if parent >= 0:
                children[parent][side] = number
            if b - a > LEAF:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                middle = (b - a) // 2  # halves by rank: equal points cannot stop the split
                order[a:b] = order[a:b][np.argpartition(own @ (other - far), middle)]
                todo += [(a, a + middle, number, 0), (a + middle, b, number, 1)]
        return cls(values, order, np.array(centres), np.array(radii), np.array(children), np.array(begin), np.array(end))


#: No score, and the range that scores are cut to.
NOTHING, LEAST, MOST = -(2**63) + 1, -(2**63) + 2, 2**63 - 1


def exact_type(largest: int, dim: int) -> type:
    """Numbers in which inner products of so large whole components are exact."""
    most = largest * largest * max(dim, 1)
    return float if most < 2**53 else np.int64 if most < 2**62 else object


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers, or doubles that are whole; unbounded ones are cut to 64 bits."""
    value = queries @ points.T
    return value if value.dtype != object else np.clip(value, LEAST, MOST).astype(np.int64)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int):
    """The best ``k`` of the tree for every query, among those that can still reach ``bound``.

    Every query opens its node of highest upper bound each round; it ends when that is below its current k-th score
    (``bound`` to begin with). A node of equal bound stays open: it may hold an equal score with a smaller id.
    """
    plain = queries.astype(float)
    norms = np.sqrt((plain ** 2).sum(axis=1))
    # rounding in the bound must never close a node: widen it a little
    upper = plain @ tree.centres.T + norms[:, None] * tree.radii[None, :]
    upper += 1e-9 * (1 + np.abs(upper) + norms[:, None] * (1 + np.sqrt((tree.centres ** 2).sum(axis=1)))[None, :])
    open_ = np.full(upper.shape, -np.inf)
    open_[:, 0] = upper[:, 0]
    kind = float if queries.dtype == float else np.int64
    none = -np.inf if kind is float else NOTHING
    scores = np.full((len(queries), k), none, dtype=kind)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    least = bound.copy()
    live = np.arange(len(queries))
    while len(live):
        node = open_[live].argmax(axis=1)
        top = open_[live, node]
        go = (top > -np.inf) & (top >= least[live])
        live, node = live[go], node[go]
        open_[live, node] = -np.inf
        inner = tree.children[node, 0] >= 0
        for side in (0, 1):
            child = tree.children[node[inner], side]
            open_[live[inner], child] = upper[live[inner], child]
        for leaf in np.unique(node[~inner]).tolist():
            who = live[~inner][node[~inner] == leaf]
            rows = tree.order[tree.begin[leaf]:tree.end[leaf]]
            value = products(queries[who], tree.points[rows])
            name = np.broadcast_to(ids[rows], value.shape)
            value[name == query_ids[who][:, None]] = none
            value = np.concatenate([scores[who], value], axis=1)
            name = np.concatenate([found[who], name], axis=1)
            name = np.where(value == none, np.iinfo(np.int64).max, name)
            best = np.lexsort((name, -value), axis=1)[:, :k]
            scores[who], found[who] = np.take_along_axis(value, best, 1), np.take_along_axis(name, best, 1)
            last = scores[who, -1]
            least[who] = np.maximum(least[who], np.where(last <= LEAST, -np.inf, last.astype(float)))
    return scores, found


def scaled(vector: str, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component as bigint."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("bigint"))


def top_k(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    every: int = 50,
    factor: float = 256.0,
    shard_rows: int = SHARD,
) -> DataFrame:
    """The ``k`` highest integer inner products of every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components become floor(factor * x). Ties go to the smaller id, then each row with that id counts. A row's own id is
    no candidate, so repeated rows with one id do not find each other. Rows without id, null vectors and vectors with null,
    NaN or infinite components take no part; vectors of different length are never compared; empty ones score 0. Products are exact
    for components of any size: doubles, 64-bit or unbounded integers, by the largest of a shard. A component that 64 bits
    cannot hold becomes the nearest they can, and so does a score; scores that are cut to one number are ties.

    Vectors are dealt by hash of id and vector to shards of about ``shard_rows``, each with a ball tree, queries to blocks. A
    block first searches one shard; its k-th scores go along to all other shards as the bound to beat. At most k
    rows per query and shard are merged. Every (block, shard) pair is a task's unit of work; it has no other state.
    """
    good = vectors.where(
        F.col(vec_id).isNotNull() & F.col(vector).isNotNull()
        & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ).select(F.col(vec_id).cast("bigint").alias("_id"), scaled(vector, factor).alias("_v"))
    good = pin(good.withColumn("_dim", F.size("_v")))
    parts = parts_of(vectors)
    sizes = good.groupBy("_dim").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(float(shard_rows))).cast("int").alias("_shards"),
        F.ceil(F.count_if(F.col("_id") % every == 0) / F.lit(float(QUERY_BLOCK))).cast("int").alias("_blocks"),
    )
    dealt = good.join(sizes, "_dim").withColumns({
        "_shard": F.pmod(F.xxhash64("_id", "_v", F.lit(1)), "_shards").cast("int"),
        "_block": F.when(F.col("_id") % every == 0, F.pmod(F.xxhash64("_id", "_v", F.lit(2)), "_blocks").cast("int")),
    })
    dealt = pin(dealt)

    def packed(rows: DataFrame, *keys: str) -> DataFrame:
        """Rows of a key as one binary matrix; the keys bound its size."""
        def run(table: pa.Table) -> pa.Table:
            dim = table["_dim"][0].as_py()
            values = table["_v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim)
            columns = {c: table[c].slice(0, 1) for c in keys} | {
                "_ids": pa.array([table["_id"].to_numpy().tobytes()], pa.binary()),
                "_values": pa.array([values.astype("<i8").tobytes()], pa.binary()),
            }
            return pa.table(columns)

        spec = ", ".join(f"{c} int" for c in keys)
        return rows.groupBy(*keys).applyInArrow(run, f"{spec}, _ids binary, _values binary")

    shards = pin(packed(dealt, "_dim", "_shard"))
    blocks = pin(packed(dealt.where("_block is not null"), "_dim", "_block"))
    blocks = blocks.join(sizes, "_dim").withColumn("_first", F.pmod("_block", "_shards"))

    def matched(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    made = _search_pair(row, k)
                    if made is not None:
                        yield made

        wanted = ["_dim", "_block", "_ids", "_values", "_sids", "_svalues", "_least"]
        return pairs.repartition(parts, "_dim", "_block", "_shard").select(*wanted).mapInArrow(
            run, "_dim int, _block int, query_id long, vec_id long, score long"
        )

    renamed = shards.select("_dim", "_shard", F.col("_ids").alias("_sids"), F.col("_values").alias("_svalues"))
    own = blocks.withColumnRenamed("_first", "_shard").withColumn("_least", F.lit(None).cast("binary"))
    first = pin(matched(own.join(renamed, ["_dim", "_shard"])))

    def least(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["query_id", "score"], ascending=[True, False])
        kth = frame.groupby("query_id")["score"].agg(lambda x: x.iloc[k - 1] if len(x) >= k else None).dropna()
        both = np.stack([kth.index.to_numpy(np.int64), kth.to_numpy(np.int64)])
        return pa.table({c: table[c].slice(0, 1) for c in ("_dim", "_block")} | {"_least": pa.array([both.tobytes()], pa.binary())})

    bounds = first.groupBy("_dim", "_block").applyInArrow(least, "_dim int, _block int, _least binary")
    others = blocks.join(bounds, ["_dim", "_block"], "left").withColumn(
        "_shard", F.explode(F.sequence(F.lit(0), F.col("_shards") - 1))
    ).where(F.col("_shard") != F.col("_first"))
    rest = matched(others.join(renamed, ["_dim", "_shard"]))
    better = F.sort_array(F.collect_list(F.struct(F.expr("-score").alias("s"), F.col("vec_id").alias("v"))))
    # at most k rows per query and shard come together here
    merged = first.unionByName(rest).groupBy("_dim", "query_id").agg(F.slice(better, 1, k).alias("_best"))
    return merged.select("query_id", F.posexplode("_best").alias("_place", "_one")).select(
        "query_id", (F.col("_place") + 1).alias("rank"), F.col("_one.v").alias("vec_id"), (-F.col("_one.s")).alias("score")
    )


def _search_pair(row: dict, k: int) -> pa.RecordBatch | None:
    dim = row["_dim"]
    matrix = lambda ids, values: (np.frombuffer(ids, "<i8"), np.frombuffer(values, "<i8").reshape(-1, dim))
    query_ids, queries = matrix(row["_ids"], row["_values"])
    ids, points = matrix(row["_sids"], row["_svalues"])
    queries, back = np.unique(np.column_stack([query_ids, queries]), axis=0, return_inverse=True)
    query_ids, queries = queries[:, 0], queries[:, 1:]
    largest = max((abs(int(x)) for m in (points, queries) if m.size for x in (m.min(), m.max())), default=0)
    kind = exact_type(largest, dim)
    bound = np.full(len(queries), -np.inf)
    if row["_least"]:
        known, least = np.frombuffer(row["_least"], "<i8").reshape(2, -1)
        at = np.searchsorted(known, query_ids)
        ok = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == query_ids) if len(known) else np.zeros(len(at), bool)
        # a score cut from below bounds nothing
        ok[ok] = least[at[ok]] > LEAST
        bound[ok] = least[at[ok]]
    scores, found = search(BallTree.build(points.astype(kind)), ids, queries.astype(kind), query_ids, bound, k)
    real = scores > (-np.inf if scores.dtype == float else NOTHING)
    line = np.nonzero(real)[0]
    if not len(line):
        return None
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(line), dim, np.int32)), pa.array(np.full(len(line), row["_block"], np.int32)),
        pa.array(query_ids[line]), pa.array(found[real]), pa.array(scores[real].astype(np.int64)),
    ], ["_dim", "_block", "query_id", "vec_id", "score"])

