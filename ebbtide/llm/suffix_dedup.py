"""Suffix-array deduplication: a collection Burrows-Wheeler transform built column by column."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ebbtide.llm.blocks import BLOCK_BYTES, blocks, decode, parts_of, read_bits, send, shared, with_answers
from ebbtide.llm.kernels import bytes_of, cover_spans, hash_spans, keep_bytes, mix, rolling_bytes, spread

#: Bytes of a minimizer; collections that a shuffle partition is cut into.
SEED, COLLECTIONS = 18, 16
#: Ends a text in the transform. UTF-8 has no such byte; it is sorted behind all others, where nothing is looked up.
END = 255
NO_ID = np.iinfo(np.int64).max


ROW = 16
#: 255 at the columns before, and after, each column of a row.
_BEFORE = np.where(np.arange(ROW)[None, :] < np.arange(ROW)[:, None], 255, 0).astype(np.uint8)
_AFTER = np.where(np.arange(ROW)[None, :] > np.arange(ROW)[:, None], 255, 0).astype(np.uint8)


class Ranges:
    """Minima of index ranges of a byte array: short rows and a sparse table over the rows."""

    def __init__(self, values: np.ndarray) -> None:
        rows = -(-len(values) // ROW)
        self.rows = np.full((rows, ROW), 255, dtype=np.uint8)
        self.rows.ravel()[:len(values)] = values
        self.levels = [self.rows.min(axis=1)]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= rows:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The minimum of [low, high] for every pair."""
        a, b, last = low // ROW, high // ROW, high % ROW
        one = a == b
        out = (self.rows[a] | _BEFORE[low % ROW] | _AFTER[np.where(one, last, ROW - 1)]).min(axis=1)
        two = np.flatnonzero(~one)
        out[two] = np.minimum(out[two], (self.rows[b[two]] | _AFTER[last[two]]).min(axis=1))
        count = b - a - 1
        many = np.flatnonzero(count > 0)
        level = np.frexp(count[many])[1] - 1
        for i in np.flatnonzero(np.bincount(level)).tolist():
            at = many[level == i]
            table = self.levels[i]
            out[at] = np.minimum(out[at], np.minimum(table[a[at] + 1], table[b[at] - (1 << i)]))
        return out


def collection_transform(data: np.ndarray, cuts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of many texts and the common prefixes (up to ``cap``) of neighbouring suffixes.

    Every round puts one suffix of each text that is long enough into the sorted suffixes of all texts: the one
    that is a byte longer. Its place follows from its first byte and the place of the suffix before it; only the
    common prefixes with its two neighbours change, and they follow from a range minimum. Each round reads the
    arrays once in order and writes them once in order.
    """
    texts, sizes = len(cuts) - 1, np.diff(cuts)
    bwt = np.full(texts, END, dtype=np.uint8)
    bwt[sizes > 0] = data[cuts[1:][sizes > 0] - 1]
    lcp = np.zeros(texts, dtype=np.uint8)
    place = np.arange(texts)
    for size in range(1, int(sizes.max(initial=0)) + 1):
        going = np.flatnonzero(sizes >= size)
        order = np.argsort(bwt, kind="stable")
        order = order[:len(order) - (texts - len(going))]
        rank = np.empty(len(bwt), dtype=np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        own = rank[place[going]]
        # both neighbours of each new suffix
        marks = np.zeros(len(order) + 1, dtype=bool)
        marks[own] = marks[own + 1] = True
        near = np.flatnonzero(marks[:-1])
        before = order[np.maximum(near - 1, 0)]
        same = (near > 0) & (bwt[before] == bwt[order[near]])
        value = np.zeros(len(near), dtype=np.uint8)
        if same.any():
            value[same] = np.minimum(Ranges(lcp).least(before[same] + 1, order[near[same]]), cap - 1) + 1
        place[going] = texts + rank[place[going]]
        fresh = np.zeros(len(bwt) + len(going), dtype=bool)
        fresh[place[going]] = True
        symbol = np.full(len(going), END, dtype=np.uint8)
        more = sizes[going] > size
        symbol[more] = data[cuts[1:][going[more]] - size - 1]
        wider, longer, old = np.empty(len(fresh), np.uint8), np.empty(len(fresh), np.uint8), ~fresh
        wider[old], longer[old] = bwt, lcp
        wider[place[going]] = symbol
        longer[texts + near] = value
        bwt, lcp = wider, longer
    return bwt, lcp


def first_owner(data: np.ndarray, cuts: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of every ``width``-byte string of the texts, text by text, and where each text's begin."""
    bwt, lcp = collection_transform(data, cuts, width)
    texts, sizes = len(cuts) - 1, np.diff(cuts)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), dtype=np.int64)
    step[order] = np.arange(len(bwt)) + texts
    windows = np.maximum(sizes - width + 1, 0)
    begin = np.concatenate([[0], np.cumsum(windows)])
    where = np.empty(int(begin[-1]), dtype=np.int64)
    place = np.arange(texts)
    for size in range(1, int(sizes.max(initial=0)) + 1):
        going = np.flatnonzero(sizes >= size)
        place[going] = step[place[going]]
        if size >= width:
            where[begin[going] + sizes[going] - size] = place[going]
    owner = np.full(len(bwt), NO_ID)
    owner[where] = np.repeat(owners, windows)
    starts = np.flatnonzero(lcp < width)
    least = np.minimum.reduceat(owner, starts) if len(starts) else owner
    return least[np.searchsorted(starts, where, side="right") - 1], begin


class _Pieces:
    """The strings of a block, cut where their minimizer changes.

    The minimizer of a ``width``-byte string is its leftmost ``SEED``-byte part of least hash. Neighbouring strings with
    one minimizer make a piece, so equal strings lie in pieces of equal minimizer, and a piece is short.
    """

    def __init__(self, batch: pa.RecordBatch, width: int) -> None:
        self.data, self.cuts = bytes_of(batch.column("_text"))
        self.width = width
        ids = batch.column("_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = np.where(known, ids.fill_null(0).to_numpy(), NO_ID)
        self.seed = min(SEED, width)
        seeds, span = rolling_bytes(self.data, self.seed), width - self.seed + 1
        sizes = np.diff(self.cuts)
        count = np.maximum(sizes - width + 1, 0)
        self.starts = np.repeat(self.cuts[:-1], count) + spread(count)
        doc = np.repeat(np.arange(len(sizes)), count)
        at = np.zeros(max(len(seeds) - span + 1, 0), dtype=np.int64)
        chunk = 1 << 20
        for a in range(0, len(at), chunk):
            part = seeds[a:a + chunk + span - 1]
            value = part & ~np.uint64((1 << 24) - 1) | np.arange(len(part), dtype=np.uint64)
            reach = 1
            while reach * 2 <= span:
                value = np.minimum(value[:-reach], value[reach:])
                reach *= 2
            n = min(chunk, len(at) - a)
            value = np.minimum(value[:n], value[span - reach:span - reach + n])
            at[a:a + n] = a + (value & np.uint64((1 << 24) - 1)).astype(np.int64)
        least = at[self.starts]
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        self.first = np.flatnonzero(new)
        self.windows = np.diff(np.append(self.first, len(least)))
        self.keys = mix(seeds[least[self.first]] + np.uint64(3))
        self.seeds = least[self.first] - self.starts[self.first]
        self.docs = doc[self.first]
        self.unique, self.of_piece, times = np.unique(self.keys, return_inverse=True, return_counts=True)
        self.again = times > 1

    def candidates(self, elsewhere: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
        """Pieces whose minimizer comes again; the distinct ones sorted by part; the distinct one of each."""
        chosen = np.flatnonzero((self.again | elsewhere)[self.of_piece])
        begin = self.starts[self.first[chosen]]
        codes = hash_spans(self.data, begin, begin + self.windows[chosen] + self.width - 1)
        part = ((self.keys[chosen] >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        order = np.lexsort((self.ids[self.docs[chosen]], codes, part))
        new = np.ones(len(order), dtype=bool)
        new[1:] = codes[order[1:]] != codes[order[:-1]]
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        heads = chosen[order[new]]
        return chosen, heads, part[order[new]], group


def undecided(data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: np.ndarray, width: int) -> np.ndarray:
    """Which of some distinct pieces can share a ``width``-byte string with another one.

    ``seed`` is where a piece's minimizer begins. A string that two pieces share has it at one place in both, so they agree in at least
    half of the string's other bytes on its left or on its right. A piece that agrees with no other one there is its strings' only holder.
    """
    span = min(SEED, width)
    half = (width - span) // 2
    out = np.zeros(len(size), dtype=bool)
    if not len(size):
        return out
    runs = rolling_bytes(data, span + half)
    for low in (seed - half, seed):
        inside = np.flatnonzero((low >= 0) & (low + span + half <= size))
        _, which, times = np.unique(runs[begin[inside] + low[inside]], return_inverse=True, return_counts=True)
        out[inside] |= times[which] > 1
    return out


def least_owners(
    data: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: np.ndarray, owner: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of every ``width``-byte string of distinct pieces, piece by piece, and where each piece's begin."""
    windows = size - width + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(owner, windows)
    # the owner of a piece that holds its strings alone is the smallest id of its copies; the others go through the transform
    among = np.flatnonzero(undecided(data, begin, size, seed, width))
    cuts = np.concatenate([[0], np.cumsum(size[among])])
    found, _ = first_owner(_bytes_at(data, begin[among], size[among]), cuts, owner[among], width)
    least[np.repeat(first[among], windows[among]) + spread(windows[among])] = found
    return least, first


def _bytes_at(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[np.repeat(begin, size) + spread(size)]


SENT = "block long, part int, n int, body binary"


def suffix_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: Sequence[str] = (),
    width: int = 50,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Remove every byte inside a ``width``-byte string that also starts in a document with a smaller id.

    Returns doc_id, ``carry``, kept (the bytes left), n_bytes, n_removed and n_spans (maximal removed runs). Strings never
    cross documents and are judged on the input. Null texts are empty; texts under ``width`` bytes stay whole. Rows with
    one id are one owner and do not remove each other's bytes; rows without id come after all others. Other columns
    do not take part.

    Texts are cut into pieces at their minimizers; only pieces whose minimizer comes again move. A block sends each of its
    distinct pieces once, with the smallest id that holds it, so a group of copies costs one piece per block. All pieces of a
    minimizer meet in one collection, where the transform and common prefixes find equal strings among the pieces that agree
    with another one beside the minimizer; no others can share a string.
    """
    named = list(dict.fromkeys(carry))
    schema = StructType([
        docs.schema[doc_id], *[docs.schema[c] for c in named], StructField("kept", BinaryType()), StructField("n_bytes", LongType()),
        StructField("n_removed", LongType()), StructField("n_spans", LongType()),
    ])
    if len({f.name.lower() for f in schema}) < len(schema):
        raise ValueError(f"columns named twice in {schema.names}")
    inner = docs.select(
        F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"), F.struct(*[F.col(c) for c in named], F.lit(0).alias("_")).alias("_more")
    )
    parts, arrow = parts_of(docs), to_arrow_schema(schema)
    fine = parts * COLLECTIONS
    packed = blocks(inner, "_text", ["_id", "_text", "_more"], block_bytes)
    asked = with_answers(packed, shared(send(packed, lambda batch: (_Pieces(batch, width).unique, None), parts), parts, "near"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for rows in batches:
            for row in range(rows.num_rows):
                own = _Pieces(decode(rows.column("payload")[row].as_buffer()), width)
                _, heads, part, _ = own.candidates(read_bits(own.unique, parts, rows.column("near")[row].as_py()), fine)
                edges = np.flatnonzero(np.diff(part, prepend=-1))
                out = []
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
                    size = own.windows[heads[a:b]] + width - 1
                    body = size.astype("<u2").tobytes() + own.ids[own.docs[heads[a:b]]].astype("<i8").tobytes()
                    body += own.seeds[heads[a:b]].astype("<u2").tobytes()
                    body += _bytes_at(own.data, own.starts[own.first[heads[a:b]]], size).tobytes()
                    out.append((rows.column("block")[row].as_py(), int(part[a]), b - a, squeeze.compress(body)))
                if out:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))
                    ], ["block", "part", "n", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for block, part, n, body in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "n", "body"))):
                held[part].append((block, n, body))
        grow = zstandard.ZstdDecompressor()
        for part in sorted(held):
            rows = held.pop(part)
            raw = [(n, grow.decompress(body)) for _, n, body in rows]
            size = np.concatenate([np.frombuffer(x, "<u2", n) for n, x in raw]).astype(np.int64)
            ids = np.concatenate([np.frombuffer(x, "<i8", n, 2 * n) for n, x in raw])
            seed = np.concatenate([np.frombuffer(x, "<u2", n, 10 * n) for n, x in raw]).astype(np.int64)
            data = np.concatenate([np.frombuffer(x, np.uint8, -1, 12 * n) for n, x in raw])
            begin = np.cumsum(size) - size
            codes = hash_spans(data, begin, begin + size)
            _, head, group = np.unique(codes, return_index=True, return_inverse=True)
            owner = np.full(len(head), NO_ID)
            np.minimum.at(owner, group, ids)
            windows = size - width + 1
            least, first = least_owners(data, begin[head], size[head], seed[head], owner, width)
            gone = least[np.repeat(first[group], windows) + spread(windows)] < np.repeat(ids, windows)
            edges = np.concatenate([[0], np.cumsum(windows)])[np.cumsum([0, *(n for n, _ in raw)])]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()),
                pa.array([np.packbits(gone[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
            ], ["block", "part", "bits"])

    told = asked.mapInArrow(pieces, SENT).repartition(parts, "part").mapInArrow(compare, "block long, part int, bits binary")
    ordered = F.sort_array(F.collect_list(F.struct("part", "bits")))
    answers = told.groupBy("block").agg(F.transform(ordered, lambda x: x["bits"]).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in range(rows.num_rows):
                batch = decode(rows.column("payload")[row].as_buffer())
                own = _Pieces(batch, width)
                chosen, heads, part, group = own.candidates(read_bits(own.unique, parts, rows.column("near")[row].as_py()), fine)
                windows = own.windows[heads]
                edges = np.concatenate([[0], np.cumsum(windows)])
                flags = np.zeros(int(edges[-1]), dtype=bool)
                runs = np.flatnonzero(np.diff(part, prepend=-1))
                for a, b, bits in zip(runs, [*runs[1:], len(part)], rows.column("gone")[row].as_py() or ()):
                    n = int(edges[b] - edges[a])
                    flags[edges[a]:edges[b]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                size = own.windows[chosen]
                hit = flags[np.repeat(edges[group], size) + spread(size)]
                # another document of this block holds the same piece under a smaller id
                hit |= np.repeat(own.ids[own.docs[chosen]] > own.ids[own.docs[heads[group]]], size)
                starts = own.starts[np.repeat(own.first[chosen], size) + spread(size)][hit]
                gone = cover_spans(starts, width, len(own.data))
                yield _result(batch, own, gone, named, arrow)

    return with_answers(asked, answers).mapInArrow(cut, schema)


def _result(batch: pa.RecordBatch, own: _Pieces, gone: np.ndarray, named: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    data, cuts = keep_bytes(own.data, own.cuts, ~gone)
    edge = np.zeros(len(gone) + 1, dtype=bool)
    edge[own.cuts] = True
    begins = gone & (edge[:-1] | ~np.append(False, gone[:-1])) if len(gone) else gone
    total = np.concatenate([[0], np.cumsum(begins)])
    sizes = np.diff(own.cuts)
    kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
    more = batch.column("_more")
    columns = [
        batch.column("_id"), *[more.field(c) for c in named], kept, pa.array(sizes), pa.array(sizes - np.diff(cuts)),
        pa.array(total[own.cuts[1:]] - total[own.cuts[:-1]]),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
