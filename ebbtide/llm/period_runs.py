"""Stretches of words that repeat with a period, found with a suffix automaton and link-cut access."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ebbtide.llm.blocks import slices
from ebbtide.llm.kernels import Words, bytes_of, cover_spans, keep_bytes, mix, rolling, text_array

#: Bytes of text whose words are hashed together.
STEP = 1 << 20
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


class LastEnds:
    """The suffix links of an automaton as a link-cut forest, coloured by the last end of each state's strings.

    A preferred path is one splay tree ordered by depth. All its states have the same last end, kept at the tree's root:
    it moves when a rotation makes another state the root. State 0 stands for none, state 1 is the start.
    """

    def __init__(self) -> None:
        self.left, self.right, self.up, self.last = [0, 0], [0, 0], [0, 0], [0, 0]

    def add(self, link: int) -> None:
        """A new state without an end, a path of its own below ``link``."""
        self.left.append(0)
        self.right.append(0)
        self.up.append(link)
        self.last.append(0)

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = right[x]
            left[p], right[x] = inner, p
        else:
            inner = left[x]
            right[p], left[x] = inner, p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            self.last[x] = self.last[p]

    def splay(self, x: int) -> None:
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while True:
            p = up[x]
            if not p:
                return
            x_left = left[p] == x
            if not x_left and right[p] != x:
                return
            g = up[p]
            if g:
                if left[g] == p:
                    rotate(p if x_left else x)
                elif right[g] == p:
                    rotate(x if x_left else p)
            rotate(x)

    def insert_above(self, state: int) -> None:
        """The newest state, between ``state`` and its link, with the last end of ``state``."""
        new = len(self.up) - 1
        self.splay(state)
        above = self.left[state]
        self.left[new], self.up[new], self.left[state] = above, state, new
        if above:
            self.up[above] = new

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Colour the path from the start to ``state`` with ``end``; its old segments as (deepest state, last end)."""
        right, up, last, splay = self.right, self.up, self.last, self.splay
        segments, below = [], 0
        while state:
            splay(state)
            before = last[state]
            segments.append((state, before))
            if right[state]:
                last[right[state]] = before
            right[state] = below
            below, state = state, up[state]
        last[below] = end
        return segments


def squares(values: Sequence[int]) -> Iterator[tuple[int, int]]:
    """(end, period) of the squares, by end: two equal neighbouring halves of ``period`` values, the last one at ``end``.

    The values are appended to a suffix automaton. The strings that end at the newest value lie on one path of suffix links.
    A segment of it whose strings ended last at ``end - p`` and reach a length of at least p is a string of period p that is
    two periods long; p is its smallest period, because a shorter one would be a later end. Every run of smallest period p is
    met at each of its ends from the second period on: there its last p values ended p places before, and not later.
    """
    forest = LastEnds()
    length, link, edges = [0, 0], [0, 0], [{}, {}]
    tip = 1
    for end, value in enumerate(values, 1):
        new = len(length)
        length.append(length[tip] + 1)
        edges.append({})
        at = tip
        while at and value not in edges[at]:
            edges[at][value] = new
            at = link[at]
        if not at:
            link.append(1)
            forest.add(1)
        else:
            to = edges[at][value]
            if length[to] == length[at] + 1:
                link.append(to)
                forest.add(to)
            else:
                copy = new + 1
                link += [copy, link[to]]
                forest.add(copy)
                length.append(length[at] + 1)
                edges.append(edges[to].copy())
                forest.add(0)
                forest.insert_above(to)
                link[to] = copy
                while at and edges[at].get(value) == to:
                    edges[at][value] = copy
                    at = link[at]
        tip = new
        for state, last in forest.access(new, end):
            if last and end - last <= length[state]:
                yield end - 1, end - last


def runs_of(values: Sequence[int], least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` values and two periods, by start, then period.

    The ends of the squares of one period that follow each other belong to one run; two runs of one period share less than a
    period, so there is a gap between their ends. The first end gives the start, the last one the length.
    """
    found, open_ = [], {}

    def close(period: int) -> None:
        first, last = open_[period]
        start = first - 2 * period + 1
        if last + 1 - start >= least:
            found.append((start, last + 1 - start, period))

    for end, period in squares(values):
        held = open_.get(period)
        if held is not None and held[1] == end - 1:
            held[1] = end
            continue
        if held is not None:
            close(period)
        open_[period] = [end, end]
    for period in open_:
        close(period)
    return sorted(found)


def stretches(values: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of words that can hold runs; a run lies in one stretch.

    In a run of at least ``least`` words and two periods, all but the last period's word runs of ``least / 2`` recur a period
    later, in the same run, at no more than half its length. So words outside such recurring word runs are in no run. What is
    left falls into stretches; word runs must recur inside their stretch, so this is repeated until little more goes.
    """
    gram = max(1, -(-least // 2))
    place = np.arange(len(values))
    while True:
        count = len(place) - gram + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = values[place]
        starts = np.flatnonzero(group[:count] == group[gram - 1:])
        keys = rolling(own, gram)[starts] ^ mix(group[starts].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        sizes = np.bincount(group)
        near = starts[order[1:]] - starts[order[:-1]] <= sizes[group[starts[order[1:]]]] // 2
        again = (keys[1:] == keys[:-1]) & near
        hit = np.zeros(len(starts), dtype=bool)
        hit[order[1:]] = again
        hit[order[:-1]] |= again
        cover = cover_spans(starts[hit], gram, len(place))
        kept = np.flatnonzero(cover)
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.ones(len(kept), dtype=bool)
        new[1:] = (np.diff(kept) > 1) | (np.diff(group[kept]) != 0)
        number = np.cumsum(new) - 1
        long = (np.bincount(number) >= least)[number]
        before, place, group = len(place), place[kept[long]], number[long]
        if not len(place):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        group = np.cumsum(np.append(0, np.diff(group) != 0))
        if len(place) > 0.95 * before:
            edge = np.flatnonzero(np.append(True, np.diff(group) != 0))
            begin = place[edge]
            return begin, begin + np.diff(np.append(edge, len(place)))


def runs_of_texts(words: Words, least: int) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of the runs of many texts, by text, start, period; starts count words of the text."""
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    found = []
    for a, b in zip(*stretches(words.hashes(), text, least)):
        numbers: dict[bytes, int] = {}
        spans = zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())
        values = [numbers.setdefault(words.data[s:e].tobytes(), len(numbers)) for s, e in spans]
        number = int(text[a])
        shift = int(a - words.first[number])
        found += [(number, start + shift, length, period) for start, length, period in runs_of(values, least)]
    return sorted(found)


def collapse(words: Words, runs: Sequence[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the words outside the later periods of all runs, joined by one space."""
    change = np.zeros(len(words.starts) + 1, dtype=np.int64)
    for number, start, length, period in runs:
        change[words.first[number] + start + period] += 1
        change[words.first[number] + start + length] -= 1
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    text = np.searchsorted(words.first[1:], stay, side="right")
    marks = np.zeros(len(words.data) + 1, dtype=np.int32)
    marks[words.starts[stay]] = 1
    marks[words.ends[stay]] -= 1
    keep = np.cumsum(marks[:-1]) > 0
    # the byte behind a word parts it from the next one of its text that stays
    inner = words.ends[stay[:-1]][text[:-1] == text[1:]]
    data = words.data.copy()
    data[inner], keep[inner] = 32, True
    return keep_bytes(data, words.cuts, keep)


def period_runs(
    docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), least: int = 12
) -> DataFrame:
    """The periodic runs of words of every row's whole text: the ``carry`` columns, n_words, runs and collapsed.

    A word is a run of characters other than space and control characters 9 to 13; equal bytes are equal words. A run is a
    stretch with smallest period q (words q apart are equal), at least ``least`` and 2 q words long, that no neighbouring
    word extends. ``runs`` lists (start, length, period) by start, then period; starts count words from 0. ``collapsed`` are
    the words that no run holds after its first q words, joined by one space.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one: repeated rows
    and null ids are answered like others, other columns are ignored. No row moves to another task. Most words are in no run
    and are sorted out by hashed word runs; an automaton is built per remaining stretch of a text, about 0.7 kB a word.
    """
    made = {"n_words", "runs", "collapsed"}
    if made & set(carry):
        raise ValueError(f"carry may not hold {sorted(made & set(carry))}")
    schema = StructType([
        *docs.select(*carry).schema, StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)),
        StructField("collapsed", StringType()),
    ])
    arrow, names = to_arrow_schema(schema), list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text", STEP):
                words = Words(*bytes_of(part.column("_text")))
                found = runs_of_texts(words, least)
                columns = np.array(found, dtype=np.int64).reshape(-1, 4)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(columns[:, 0], np.arange(part.num_rows + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in (1, 2, 3)], names=RUN.names),
                )
                own = [part.column(c) for c in range(len(names))]
                made = [*own, pa.array(words.counts), lists, text_array(*collapse(words, found))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    wanted = [*[F.col(c).alias(f"_{k}") for k, c in enumerate(names)], F.col(text).cast("string").alias("_text")]
    return docs.select(*wanted).mapInArrow(run, schema)


def run_digests() -> list[Column]:
    """n_runs, the greatest run (then smallest start, then period) and digests of the runs and the collapsed text."""
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    greatest = F.transform(F.array(greatest), lambda r: F.struct(
        (-r["col2"]).alias("start"), r["length"].alias("length"), (-r["col3"]).alias("period")))[0]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    period = greatest["period"]
    return [
        F.size("runs").cast("bigint").alias("n_runs"),
        greatest["start"].alias("start"), greatest["length"].alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * greatest["length"] / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ]


def repeated_tails(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the ids, chosen by checksum, go on repeating a part of their words to the end."""
    number = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        rest = F.floor(number / 10).cast("bigint")
        first = F.pmod(rest, F.size(w)).cast("int")
        period = (F.lit(1) + F.floor((F.size(w) - first) / (F.lit(3) + F.pmod(rest, F.lit(8))))).cast("int")
        head, tail = F.slice(w, F.lit(1), first), F.slice(w, first + 1, period)
        turns = F.ceil((F.size(w) - first) / period).cast("int")
        whole = F.concat(head, F.flatten(F.array_repeat(tail, turns)))
        return F.array_join(F.slice(whole, F.lit(1), F.size(w)), " ")

    changed = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select(doc_id, F.when(number % 10 == 0, changed).otherwise(F.col(text)).alias(text))
