"""Byte-level BPE encoding and decoding with length-bucketed matrices."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ebbtide.llm.blocks import BLOCK_BYTES, slices
from ebbtide.llm.kernels import mix, spread

NO_PAIR = np.int32(2**31 - 1)
#: Pieces of more bytes are merged one by one, in whole sets of equal pairs.
WIDE = 64
#: A worker forgets its pieces when it holds so many; they are then encoded again.
REMEMBERED = 400_000


@dataclass
class Vocabulary:
    """Ranks as arrays: a hashed table of mergeable pairs, single bytes, whole pieces and the bytes of every id."""

    whole: dict[bytes, int]
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    byte_ids: np.ndarray
    flat: np.ndarray
    cuts: np.ndarray
    #: ids with a neighbour whose merge has a lower rank than the id itself
    early: np.ndarray
    pattern: str
    _seen: dict = field(default_factory=dict, repr=False)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by linear probing."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        mask = np.uint64(len(self.pair_keys) - 1)
        slot = mix(keys) & mask
        held = self.pair_keys[slot]
        out = np.where(held == keys, self.pair_ranks[slot], NO_PAIR)
        open_ = np.flatnonzero((held != keys) & (held != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
            held = self.pair_keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.pair_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != EMPTY)]
        return out


EMPTY = np.uint64(2**64 - 1)


@cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file: a token in base 64 and its rank on every line."""
    with open(path, "rb") as lines:
        whole = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(whole, key=whole.get)
    ids = np.array([whole[t] for t in tokens], dtype=np.int64)
    size = np.zeros(int(ids.max()) + 1, dtype=np.int64)
    size[ids] = [len(t) for t in tokens]
    pairs = []
    for token, rank in whole.items():
        for cut in range(1, len(token)):
            a, b = whole.get(token[:cut]), whole.get(token[cut:])
            if a is not None and b is not None:
                pairs.append((a, b, rank))
    table = np.array(pairs, dtype=np.int64)
    early = np.zeros(len(size), dtype=bool)
    early[table[table[:, 2] < table[:, 0], 0]] = True
    early[table[table[:, 2] < table[:, 1], 1]] = True
    slots = 1 << (2 * len(pairs)).bit_length()
    keys, ranks = np.full(slots, EMPTY, dtype=np.uint64), np.zeros(slots, dtype=np.int32)
    wanted = table[:, 0].astype(np.uint64) << np.uint64(32) | table[:, 1].astype(np.uint64)
    place, todo = mix(wanted) & np.uint64(slots - 1), np.arange(len(wanted))
    while len(todo):
        free = todo[keys[place[todo]] == EMPTY]
        _, first = np.unique(place[free], return_index=True)
        put = free[first]
        keys[place[put]], ranks[place[put]] = wanted[put], table[put, 2]
        todo = todo[keys[place[todo]] != wanted[todo]]
        place[todo] = (place[todo] + np.uint64(1)) & np.uint64(slots - 1)
    return Vocabulary(
        whole, keys, ranks, np.array([whole[bytes([b])] for b in range(256)], dtype=np.int32),
        np.frombuffer(b"".join(tokens), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)]), early,
        # white space as Unicode's property: the pattern's language counts no separators 28 to 31 as such
        pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"),
    )


def merge_matrix(ids: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Merge the leftmost pair of minimum rank of every row, round by round.

    ``ids`` is padded on the right. Rows without a mergeable pair leave; the others lose one column each.
    Returns (rows, ids, lengths) of what has left.
    """
    rows, done = np.arange(len(ids)), []
    inner = np.arange(ids.shape[1] - 1)
    ranks = np.full((len(ids), ids.shape[1] - 1), NO_PAIR, dtype=np.int32)
    real = inner[None, :] < lengths[:, None] - 1
    ranks[real] = vocab.ranks(ids[:, :-1][real], ids[:, 1:][real])
    while len(rows):
        at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), dtype=np.int64)
        best = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NO_PAIR)
        over = best == NO_PAIR
        if over.any():
            done.append((rows[over], ids[over], lengths[over]))
            live = ~over
            rows, ids, lengths, ranks, at, best = rows[live], ids[live], lengths[live], ranks[live], at[live], best[live]
            if not len(rows):
                break
        line = np.arange(len(rows))
        ids[line, at] = best
        keep = np.ones(ids.shape, dtype=bool)
        keep[line, at + 1] = False
        ids = ids[keep].reshape(len(rows), -1)
        keep = np.ones(ranks.shape, dtype=bool)
        keep[line, at] = False
        ranks = ranks[keep].reshape(len(rows), -1)
        lengths = lengths - 1
        for place in (at - 1, at):
            ok = np.flatnonzero((place >= 0) & (place + 1 < lengths))
            if len(ok):
                p = place[ok]
                ranks[ok, p] = vocab.ranks(ids[ok, p], ids[ok, p + 1])
            if place is at:
                last = np.flatnonzero((place + 1 >= lengths) & (place < ranks.shape[1]))
                ranks[last, place[last]] = NO_PAIR
    return done


def merge_wide(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """The same for one long piece: all pairs of the minimum rank in a round, from the left without overlap.

    That equals one at a time unless the new id could merge with a neighbour at a lower rank still (``early``); such
    ids are merged singly.
    """
    ranks = vocab.ranks(ids[:-1], ids[1:])
    while len(ranks):
        best = ranks.min()
        if best == NO_PAIR:
            break
        at = np.flatnonzero(ranks == best)
        if vocab.early[best]:
            at = at[:1]
        elif len(at) > 1:
            run = np.cumsum(np.append(True, np.diff(at) > 1))
            begin = np.flatnonzero(np.append(True, np.diff(run) > 0))
            at = at[(np.arange(len(at)) - begin[run - 1]) % 2 == 0]
        ids[at] = best
        ids = np.delete(ids, at + 1)
        ranks = np.delete(ranks, at)
        at = at - np.arange(len(at))
        near = np.unique(np.concatenate([at - 1, at]))
        near = near[(near >= 0) & (near < len(ranks))]
        ranks[near] = vocab.ranks(ids[near], ids[near + 1])
    return ids


def encode_pieces(pieces: Sequence[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every piece, one after the other, and the number of ids of each."""
    counts = np.zeros(len(pieces), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # piece of each id (in order), id
    known = np.fromiter((vocab.whole.get(p, -1) for p in pieces), dtype=np.int64, count=len(pieces))
    hit = np.flatnonzero(known >= 0)
    counts[hit] = 1
    parts.append((hit, known[hit].astype(np.int32)))
    todo = np.flatnonzero(known < 0)
    sizes = np.fromiter((len(pieces[i]) for i in todo), dtype=np.int64, count=len(todo))
    low = 0
    for high in (4, 8, 12, 16, 24, 32, WIDE):
        which = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        if not len(which):
            continue
        n = sizes[which]
        flat = vocab.byte_ids[np.frombuffer(b"".join([pieces[i] for i in todo[which].tolist()]), dtype=np.uint8)]
        ids = np.zeros((len(which), high), dtype=np.int32)
        ids[np.arange(high)[None, :] < n[:, None]] = flat
        for rows, left, length in merge_matrix(ids, n, vocab):
            of = todo[which[rows]]
            counts[of] = length
            real = np.arange(left.shape[1])[None, :] < length[:, None]
            parts.append((np.repeat(of, length), left[real]))
    for i in todo[sizes > WIDE].tolist():
        ids = merge_wide(vocab.byte_ids[np.frombuffer(pieces[i], dtype=np.uint8)].copy(), vocab)
        counts[i] = len(ids)
        parts.append((np.full(len(ids), i), ids))
    out = np.empty(int(counts.sum()), dtype=np.int32)
    begin = np.cumsum(counts) - counts
    for of, ids in parts:
        if len(of):
            new = np.append(True, of[1:] != of[:-1])
            first = np.flatnonzero(new)
            out[begin[of] + np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))] = ids
    return out, counts


class _Numbers(dict):
    """Numbers new pieces in the order of their arrival."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Encoder:
    """Encodes batches of texts; a piece that was met before is looked up."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.split = regex.compile(vocab.pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.counts, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and the offset of each text."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        before = len(self.numbers)
        number = self.numbers.__getitem__
        found = [list(map(number, self.split(t))) if t else [] for t in texts]
        if len(self.numbers) > before:
            fresh = [p.encode() for p in list(self.numbers)[before:]]
            ids, counts = encode_pieces(fresh, self.vocab)
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
            self.begin = np.cumsum(self.counts) - self.counts
        pieces = np.concatenate([np.array(f, dtype=np.int64) for f in found]) if found else np.zeros(0, np.int64)
        counts = self.counts[pieces]
        ids = self.ids[np.repeat(self.begin[pieces], counts) + spread(counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])]


def decode_ids(ids: np.ndarray, cuts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ids and the offset of each list's bytes; an unknown id raises IndexError."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(vocab.cuts) - 1):
        raise IndexError(f"an id outside 0 to {len(vocab.cuts) - 2}")
    begin, size = vocab.cuts[ids], vocab.cuts[ids + 1] - vocab.cuts[ids]
    data = vocab.flat[np.repeat(begin, size) + spread(size)]
    return data, np.concatenate([[0], np.cumsum(size)])[cuts]


def _schema(docs: DataFrame, carry: Sequence[str], *more: StructField) -> StructType:
    schema = StructType([*[docs.schema[c] for c in carry], *more])
    if len({f.name.lower() for f in schema}) < len(schema):
        raise ValueError(f"columns named twice in {schema.names}")
    return schema


def _run(docs: DataFrame, column: str, carry: Sequence[str], schema: StructType, make) -> DataFrame:
    """Apply ``make(column values) -> new columns`` to slices of about one block of text."""
    arrow, carry = to_arrow_schema(schema), list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, BLOCK_BYTES):
                columns = [*[part.column(c) for c in carry], *make(part.column(column))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, column])).mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, n_tokens and ids of every whole text.

    ``path`` names a rank file that every machine holds, ``pattern`` the split; no text is a special token. Null and
    empty texts have no ids. Rows stay as they are, repeated or not, and no other column takes part.
    """
    worker: list[Encoder] = []

    def make(texts: pa.Array) -> list[pa.Array]:
        if not worker:
            worker.append(Encoder(vocabulary(path, pattern)))
        ids, cuts = worker[0].encode(texts.to_pylist())
        return [pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))]

    schema = _schema(docs, carry, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType(), False)))
    return _run(docs, text, carry, schema, make)


def bpe_decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and the decoded bytes of each list of ids; a null list gives null, an empty one no bytes."""
    arrow_carry = list(carry)
    schema = _schema(rows, carry, StructField("decoded", BinaryType()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            decoded = []
            for one in batch.column(ids):
                if one.as_py() is None:
                    decoded.append(None)
                    continue
                flat = one.values.to_numpy(zero_copy_only=False)
                decoded.append(decode_ids(flat, np.array([0, len(flat)]), vocab)[0].tobytes())
            columns = [*[batch.column(c) for c in arrow_carry], pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.select(*dict.fromkeys([*carry, ids])).mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass: n_tokens and the SHA-256 of the ids (32-bit little-endian) and of the decoded bytes.

    The same rows as ``bpe_encode`` followed by ``bpe_decode``, without moving the ids out of the task.
    """
    worker: list[Encoder] = []

    def make(texts: pa.Array) -> list[pa.Array]:
        if not worker:
            worker.append(Encoder(vocabulary(path, pattern)))
        ids, cuts = worker[0].encode(texts.to_pylist())
        data, ends = decode_ids(ids, cuts, worker[0].vocab)
        raw = memoryview(ids.astype("<u4").view(np.uint8))
        of_ids = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
        of_text = [hashlib.sha256(data[a:b].data).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return [pa.array(np.diff(cuts)), pa.array(of_ids), pa.array(of_text)]

    schema = _schema(
        docs, carry, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    )
    return _run(docs, text, carry, schema, make)
