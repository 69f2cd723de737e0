"""N-gram Jaccard join with rare-first prefixes, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ebbtide.llm.blocks import BLOCK_BYTES, blocks, decode, parts_of, read_bits, send, shared, take_rows, with_answers
from ebbtide.llm.kernels import Words, bytes_of, mix, rolling
from ebbtide.session import pin

#: Cells of the frequency sketch: a fixed size, whatever the number of documents. Grams of one cell share a count.
CELLS, SLICES = 1 << 20, 64
#: Nodes of pairs that are broadcast to filter their texts; more are joined by a shuffle alone.
FEW_NODES = 2_000_000
#: Kept prefix grams before its own that a posting of the last join holds; more only save repeated candidate rows.
BEFORE = 4
#: Rows (links, postings) and pairs of texts of one task, where their number is known. More rows are more tasks, up to the shuffle partitions.
ROWS_OF_TASK, PAIRS_OF_TASK = 1 << 16, 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gram_sets(data: np.ndarray, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of every text, one after the other, and where each text's begin.

    A text with fewer words than ``width`` has one gram of all its words, without words none.
    """
    words = Words(_LOWER[data], cuts)
    codes, counts = words.hashes(), words.counts
    runs = rolling(codes, width)
    whole = counts >= width
    size = np.where(whole, counts - width + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(doc)) - begin[doc] + words.first[:-1][doc]
    grams = np.zeros(len(doc), dtype=np.uint64)
    full = whole[doc]
    grams[full] = runs[place[full]]
    for i in np.flatnonzero(~whole & (counts > 0)).tolist():
        own = codes[words.first[i]:words.first[i + 1]]
        grams[begin[i]] = rolling(np.append(own, np.uint64(len(own))), len(own) + 1)[0]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def frequencies(packed: DataFrame, text: str, width: int) -> np.ndarray:
    """How many document grams fall in each cell, over all documents; every task sends its sums once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                grams, _ = gram_sets(*bytes_of(decode(payload.as_buffer()).column(text)), width)
                cells += np.bincount((grams & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        for i, part in enumerate(np.split(cells.astype("<i4"), SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                sums[i] = sums.get(i, 0) + np.frombuffer(part.as_buffer(), "<i4").astype(np.int64)
        for i, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part.tobytes()])], ["slice", "counts"])

    sent = packed.select("payload").mapInArrow(count, "slice int, counts binary")
    rows = sent.repartition(SLICES, "slice").mapInArrow(add, "slice int, counts binary").collect()
    cells = np.zeros((SLICES, CELLS // SLICES), dtype=np.int64)
    for row in rows:
        cells[row.slice] = np.frombuffer(row.counts, np.int64)
    return np.minimum(cells.ravel(), 2**31 - 1).astype(np.int32)


def rare_first(grams: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The order of a set: rarest cell first, ties by hash; the same for every document."""
    return np.lexsort((grams, cells[(grams & np.uint64(CELLS - 1)).astype(np.int64)]))


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def suffix_apart(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the grams that only one of two sorted sets holds: split both at a pivot, down to ``depth``."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    pivot = y[len(y) // 2]
    i, j = np.searchsorted(x, pivot), len(y) // 2
    return suffix_apart(x[:i], y[:j], depth - 1) + suffix_apart(x[i:], y[j:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, after the suffix filter."""
    total = len(x) + len(y)
    # intersection >= percent / (100 + percent) * total, so at most the rest is apart
    if (100 + percent) * (total - suffix_apart(x, y)) < 2 * percent * total:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (total - both)


def tasks_of(rows: int, each: int, parts: int) -> int:
    """As many tasks as ``rows`` need at ``each`` a task, at most ``parts``."""
    return min(parts, 1 + rows // each)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes: alternating large and small stars until nothing moves.

    Only minima and joins per round; a node with very many links is an aggregate and a splittable join. The links of a
    round are counted, and its steps run in as many tasks as they need: few links are one task without a shuffle.
    """
    edges = pin(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    figures = F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))
    stamp = edges.agg(*figures).first()
    while stamp[0]:
        tasks = tasks_of(stamp[0], ROWS_OF_TASK, parts_of(links))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = moved.coalesce(tasks).distinct()
        roots = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = pin(small.unionByName(roots.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(*figures).first()
        if now == stamp:
            break
        stamp = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def jaccard_components(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 4, percent: int = 85, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row.

    A text (A-Z lower case) has the set of its ``width``-word shingles; two texts are linked when 100 * intersection >=
    ``percent`` * union. class_id is the smallest id with an equal set, component_id the smallest id that links
    reach. Texts without words (null, empty, blank) have no shingles and stand alone. Rows without id are counted, but take
    no part: their class and component are null. Repeated rows fall in one class. Other columns do not take part.

    Equal sets become one class. Grams in rare-first order (counts of all documents in a sketch of fixed size) give each class
    a prefix; only prefix grams that another class holds are kept. In the join a gram's first class is compared
    with the others first, so that a large group of near copies becomes one component in linear work. Then every pair of
    classes that share a prefix gram, lie in different components and pass the length and positional filters is
    verified once on the whole sets, behind the suffix filter: no link between components is lost.
    """
    inner = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    packed = blocks(inner, "_text", ["_id", "_text"], block_bytes)
    return _components_of_blocks(packed, parts_of(docs), width, percent).select(
        F.col("_id").alias(doc_id), F.col("n").alias("n_shingles"), "class_id", "component_id"
    )


def one_per_component(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: Sequence[str] = (), width: int = 4, percent: int = 85,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id``, ``text`` and the ``carry`` columns of one row of every component of ``jaccard_components``.

    Every row is a node of its own, so rows that share an id and rows without id are linked by their texts as all others. The
    row with the smallest id stays, one without id only where the component has no other; rows of one id go by a hash
    of the columns, and rows that are equal in all of them are interchangeable. Texts without words all stay.
    """
    named = list(dict.fromkeys([doc_id, text, *carry]))
    own = [f"_own_{i}" for i in range(len(named))]
    inner = docs.select(
        F.monotonically_increasing_id().alias("_id"), F.col(text).alias("_text"), F.col(doc_id).cast("bigint").alias("_name"),
        F.xxhash64(*[F.col(c) for c in named]).alias("_mark"), *[F.col(c).alias(o) for c, o in zip(named, own) if c != text],
    )
    # the numbers of the rows are written with the blocks
    packed = blocks(inner, "_text", inner.columns, block_bytes)
    found = _components_of_blocks(packed, parts_of(docs), width, percent, ("_name", "_mark"))
    order = F.struct(F.col("_name").isNull().alias("none"), "_name", "_mark", "block", "row")
    stays = found.groupBy("component_id").agg(F.min(order).alias("s")).select("s.block", "s.row", F.lit(1).alias("copies"))
    columns = ["_text" if c == text else o for c, o in zip(named, own)]
    return take_rows(packed, stays, columns, StructType([docs.schema[c] for c in named]))


def _components_of_blocks(packed: DataFrame, parts: int, width: int, percent: int, extra: Sequence[str] = ()) -> DataFrame:
    """_id, n, class_id, component_id, block, row and the ``extra`` bigint columns of every row of the blocks."""
    cells = frequencies(packed, "_text", width)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                rows = decode(payload.as_buffer())
                grams, cuts = gram_sets(*bytes_of(rows.column("_text")), width)
                hashes = []
                for salt in (1, 2):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + np.uint64(salt)), dtype=np.uint64)])
                    hashes.append(pa.array((sums[cuts[1:]] - sums[cuts[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    rows.column("_id"), pa.array(np.diff(cuts)), *hashes, pa.array(np.full(rows.num_rows, block)),
                    pa.array(np.arange(rows.num_rows, dtype=np.int32)), *[rows.column(c) for c in extra],
                ], ["_id", "n", "h1", "h2", "block", "row", *extra])

    spec = ", ".join(["_id long, n long, h1 long, h2 long, block long, row int", *[f"{c} long" for c in extra]])
    known = pin(packed.mapInArrow(sets, spec))
    classes = pin(known.where("n > 0 and _id is not null").groupBy("n", "h1", "h2").agg(F.min(F.struct("_id", "block", "row")).alias("s")))
    chosen = classes.select("s.block", "s.row").groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    picked = packed.join(chosen.hint("shuffle_hash"), "block")

    def prefixes(batch: pa.RecordBatch, rows: list[int]) -> Iterator[tuple]:
        part = batch.take(pa.array(rows))
        grams, cuts = gram_sets(*bytes_of(part.column("_text")), width)
        for i, node in enumerate(part.column("_id").to_pylist()):
            own = grams[cuts[i]:cuts[i + 1]]
            yield node, len(own), own[rare_first(own, cells)[:prefix_length(len(own), percent)]], part.column("_text")[i]

    def keys(batch: pa.RecordBatch, rows: list[int]) -> tuple[np.ndarray, None]:
        return np.unique(np.concatenate([p[2] for p in prefixes(batch, rows)])), None

    asked = with_answers(picked, shared(send(picked, keys, parts), parts, "known"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in range(batch.num_rows):
                found = list(prefixes(decode(batch.column("payload")[row].as_buffer()), batch.column("rows")[row].as_py()))
                unique, inverse, times = np.unique(np.concatenate([f[2] for f in found]), return_inverse=True, return_counts=True)
                common = (read_bits(unique, parts, batch.column("known")[row].as_py()) | (times > 1))[inverse]
                at, out = 0, []
                for node, n, own, body in found:
                    here = np.flatnonzero(common[at:at + len(own)])
                    at += len(own)
                    if len(here):
                        out.append((node, n, len(own) - len(here), own[here].view(np.int64), here.astype(np.int32), squeeze.compress(body.as_buffer())))
                if out:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, k) for c, k in zip(zip(*out), (
                            pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()
                        ))
                    ], ["node", "n", "alone", "grams", "places", "body"])

    active = pin(asked.mapInArrow(post, "node long, n long, alone long, grams array<long>, places array<int>, body binary"))
    postings = active.agg(F.sum(F.size("grams"))).first()[0] or 0
    tasks = tasks_of(postings, ROWS_OF_TASK, parts)
    bodies = active.select("node", "body")
    exploded = F.posexplode(F.arrays_zip("grams", "places")).alias("earlier", "x")
    listed = active.coalesce(tasks).select("node", "n", "alone", "grams", exploded).select(
        F.col("x.grams").alias("gram"), "node", "n", "alone", F.col("x.places").alias("place"), "earlier",
        F.slice("grams", F.greatest(F.col("earlier") - (BEFORE - 1), F.lit(1)), F.least("earlier", F.lit(BEFORE))).alias("before"),
    )
    posts = listed.drop("before")

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grow = zstandard.ZstdDecompressor()
            held: tuple = (None, None)

            def grams(body: bytes) -> np.ndarray:
                data = np.frombuffer(grow.decompress(body), np.uint8)
                return gram_sets(data, np.array([0, len(data)]), width)[0]

            for batch in batches:
                good = []
                for row in batch.to_pylist():
                    if held[0] != row["a"]:
                        held = (row["a"], grams(row["body_a"]))
                    good.append(linked(held[1], grams(row["body_b"]), percent))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])

        pairs = pin(pairs)
        count = pairs.count()
        if not count:
            return pairs
        few_tasks = tasks_of(count, PAIRS_OF_TASK, parts)
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        few = len(nodes.select(F.lit(1)).take(FEW_NODES + 1)) <= FEW_NODES
        # texts that no pair needs do not move, as long as the nodes are few enough to send to every task
        needed = bodies.join(F.broadcast(nodes), "node", "left_semi") if few else bodies
        second = pairs.join(needed.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b").coalesce(few_tasks)
        both = second.join(needed.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
        return both.select("a", "b", "body_a", "body_b").coalesce(few_tasks).mapInArrow(run, "a long, b long")

    def near(p: str, q: str):
        """Length and positional filter: what two sets can share besides a gram at these places.

        Grams that both hold before it lie in both prefixes, so no more than the kept ones among the earlier grams.
        """
        m, n, i, j = F.col(f"{p}.n"), F.col(f"{q}.n"), F.col(f"{p}.place"), F.col(f"{q}.place")
        most = F.least(f"{p}.earlier", f"{q}.earlier") + 1 + F.least(m - i - 1, n - j - 1)
        return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * most >= percent * (m + n))

    links = None
    for turn in range(2):
        # stars: every class of a gram against one of them: first the one with the fewest prefix grams of its own, which is
        # nearest to what copies have in common, then a random one
        joined = posts if links is None else posts.join(components(links), "node", "left").select(
            "gram", "node", "n", "alone", "place", "earlier", F.coalesce("component", "node").alias("component")
        )
        if turn:
            mixed = joined.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
            joined = pin(joined.join(mixed.select("gram"), "gram", "left_semi").coalesce(tasks))
        order = F.xxhash64("node") if turn else F.struct("alone", "node")
        head = joined.groupBy("gram").agg(F.min_by(F.struct(*[c for c in joined.columns if c != "gram"]), order).alias("h")).select("gram", "h.*")
        apart = F.col("p.node") != F.col("q.node") if not turn else F.col("p.component") != F.col("q.component")
        met = joined.alias("p").join(head.alias("q"), "gram").where(apart & near("p", "q")).select(
            F.col("p.node").alias("node"), F.col("q.node").alias("head")
        ).coalesce(tasks).groupBy("node", "head").agg(F.count(F.lit(1)).alias("times")).coalesce(tasks)
        # one head per class, the one it shares most grams with; what this leaves apart comes up again below
        best = met.groupBy("node").agg(F.max_by("head", F.struct("times", -F.col("head"))).alias("head"))
        star = best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct().coalesce(tasks)
        found = verified(star)
        links = pin(found if links is None else links.unionByName(found).distinct().coalesce(tasks))
    merged = listed.join(components(links), "node", "left").select(
        "gram", "node", "n", "place", "earlier", "before", F.coalesce("component", "node").alias("component")
    )
    mixed = merged.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    merged = pin(merged.join(mixed.select("gram"), "gram", "left_semi").coalesce(tasks))
    # near copies share grams in rows: a pair that already met at one of the grams just before is not made again. The first
    # gram that two sets share has no shared one before it, so every pair that passes the filters comes up there at least
    rest = merged.alias("p").join(merged.alias("q"), "gram").where(
        (F.col("p.component") < F.col("q.component")) & near("p", "q") & ~F.arrays_overlap("p.before", "q.before")
    ).select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()
    links = pin(links.unionByName(verified(rest)))
    of_class = classes.select("n", "h1", "h2", F.col("s._id").alias("class_id")).join(
        components(links).withColumnRenamed("node", "class_id"), "class_id", "left"
    ).select("n", "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    joined = known.join(of_class, ["n", "h1", "h2"], "left")
    own = lambda c: F.when(F.col("_id").isNotNull(), F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("_id")))
    return joined.select(
        "_id", "n", own("class_id").alias("class_id"), own("component_id").alias("component_id"), "block", "row", *extra
    )
