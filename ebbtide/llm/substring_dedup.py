"""Substring deduplication with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

from ebbtide.llm.blocks import BLOCK_BYTES, blocks, decode, parts_of, read_bits, send, shared, with_answers
from ebbtide.llm.kernels import Words, bytes_of, cover_spans, keep_bytes, mix, rolling, spread, text_array

#: Perfect difference sets: every difference modulo the period occurs between two of the places.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of more than half the window."""
    fit = [p for p in COVERS if window - p + 1 > window // 2]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


class _Windows:
    """Anchors and windows of the texts of one block.

    An anchor is a hash of ``window - period + 1`` words at a cover place of its text. Two equal windows at places
    i and j hold equal anchors at i + d and j + d for some d below the period, because a cover has every difference.
    """

    def __init__(self, batch: pa.RecordBatch, text: str, window: int) -> None:
        self.words = Words(*bytes_of(batch.column(text)))
        self.window = window
        self.period, cover = cover_for(window)
        self.length = window - self.period + 1
        self.codes = self.words.hashes()
        counts = self.words.counts
        place, total = spread(counts), np.repeat(counts, counts)
        self.is_window = place + window <= total
        at_cover = np.isin(place % self.period, cover)
        self.anchors = np.flatnonzero(at_cover & (place + self.length <= total) & (total >= window))
        rolled = rolling(self.codes, self.length)
        self.keys, self.of_anchor, times = np.unique(
            rolled[self.anchors], return_inverse=True, return_counts=True
        )
        self.again = times > 1

    def repeated_windows(self, elsewhere: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Extend the repeated anchors: the windows around them, their hashes and second hashes."""
        hit = np.zeros(len(self.codes) + 1, dtype=np.int64)
        hit[1 + self.anchors[(self.again | elsewhere)[self.of_anchor]]] = 1
        hit = np.cumsum(hit)
        reach = np.minimum(np.arange(len(self.codes)) + self.period, len(self.codes))
        near = hit[reach] - hit[:-1] > 0
        starts = np.flatnonzero(near & self.is_window)
        first = rolling(self.codes, self.window)[starts]
        second = (rolling(mix(self.codes + np.uint64(7)), self.window)[starts] >> np.uint64(32)).astype(np.uint32)
        return starts, first, second


def _distinct_windows(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct (hash, second hash) pairs, the pair of each window, and which pairs come again."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(order), dtype=np.int64)
    inverse[order] = group
    return a[new], b[new], inverse, np.bincount(group, minlength=int(new.sum())) > 1


def substring_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    carry: Sequence[str] = (),
    window: int = 35,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Remove every word inside a window of ``window`` words that starts anywhere else as well.

    Words are runs of bytes other than space and 9 to 13. Windows lie inside one text and are judged on the input.
    Returns ``doc_id``, the ``carry`` columns, ``text`` without the removed words (a removed run takes the separators
    after its words along), n_words and n_removed. Every row is a text of its own: repeated rows and repeated
    ids are copies of each other. A null text has no words and stays null; texts with fewer words than a window stay
    as they are. Columns that are not named do not take part, whatever their names.

    Anchors at difference-cover places are compared first (a third of all places); only windows around a
    repeated anchor are hashed whole (96 bits) and compared again. Both comparisons send distinct hashes per block and
    get one bit back, so neither depends on how often one passage occurs.
    """
    named = [doc_id, *[c for c in carry if c not in (doc_id, text)], text]
    schema = StructType([*[docs.schema[c] for c in named], StructField("n_words", LongType()), StructField("n_removed", LongType())])
    if len({f.name.lower() for f in schema}) < len(schema):
        raise ValueError(f"columns named twice in {schema.names}")
    parts = parts_of(docs)
    packed = blocks(docs, text, named, block_bytes)

    def anchors(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
        return _Windows(batch, text, window).keys, None

    def windows(batch: pa.RecordBatch, near) -> tuple[np.ndarray, np.ndarray]:
        own = _Windows(batch, text, window)
        _, first, second = own.repeated_windows(read_bits(own.keys, parts, near))
        return _distinct_windows(first, second)[:2]

    candidates = with_answers(packed, shared(send(packed, anchors, parts), parts, "near"))
    decided = with_answers(candidates, shared(send(candidates, windows, parts), parts, "equal"))
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in range(rows.num_rows):
                batch = decode(rows.column("payload")[row].as_buffer())
                own = _Windows(batch, text, window)
                starts, first, second = own.repeated_windows(read_bits(own.keys, parts, rows.column("near")[row].as_py()))
                keys, _, inverse, again = _distinct_windows(first, second)
                bits = read_bits(keys, parts, rows.column("equal")[row].as_py())
                gone = cover_spans(starts[(again | bits)[inverse]], window, len(own.codes))
                yield _result(batch, own.words, gone, text, named, arrow)

    return decided.mapInArrow(cut, schema)


def _result(batch, words: Words, gone: np.ndarray, text: str, named: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    total = np.zeros(len(gone) + 1, dtype=np.int64)
    np.cumsum(gone, out=total[1:])
    removed = total[words.first[1:]] - total[words.first[:-1]]
    column = batch.column(text)
    if removed.any():
        # a removed word goes with the separators up to the next word or the end of its text
        stop = np.append(words.starts[1:], len(words.data))
        last = words.first[1:][words.counts > 0] - 1
        stop[last] = words.cuts[1:][words.counts > 0]
        change = np.zeros(len(words.data) + 1, dtype=np.int32)
        np.add.at(change, words.starts[gone], 1)
        np.add.at(change, stop[gone], -1)
        data, cuts = keep_bytes(words.data, words.cuts, np.cumsum(change[:-1]) == 0)
        kept = text_array(data, cuts, arrow.field(text).type)
        column = pc.if_else(pc.is_valid(batch.column(text)), kept, batch.column(text).cast(kept.type))
    columns = [column if c == text else batch.column(c) for c in named]
    columns += [pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64())]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)


def joined_words(text: str = "text"):
    """The words of a text joined by one space."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+", " "))
