"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ebbtide.llm.blocks import BLOCK_BYTES, slices
from ebbtide.llm.kernels import Words, bytes_of, hash_spans, mix, spread
from ebbtide.session import pin

#: Slots of the hashed features of a token, and the documents that the field is fitted on at most.
SLOTS, SAMPLE = 1 << 18, 3000
_ROUNDS, _STEP, _DECAY = 30, 0.5, 1e-6

#: Tokens are runs of letters, digits and all bytes of longer characters; A-Z count as a-z, the rest parts.
_TOKEN_BYTE = np.arange(256, dtype=np.uint8)
_TOKEN_BYTE[:128] = [c if chr(c).isalnum() else 32 for c in range(128)]
_TOKEN_BYTE[65:91] += 32


def tokens(data: np.ndarray, cuts: np.ndarray) -> Words:
    return Words(_TOKEN_BYTE[data], cuts)


def features(words: Words) -> np.ndarray:
    """Slots of every token: the word, its first 4, 5 and 7 bytes and its last 3."""
    a, b = words.starts, words.ends
    spans = [(a, b), *[(a, np.minimum(b, a + n)) for n in (4, 5, 7)], (np.maximum(a, b - 3), b)]
    return np.stack([
        (mix(hash_spans(words.data, x, y) + np.uint64(i)) & np.uint64(SLOTS - 1)).astype(np.int32) for i, (x, y) in enumerate(spans)
    ], axis=1)


#: Tokens of a text that are chained one by one; longer texts are chained by the products of such segments.
SEGMENT = 64


def marginals(score: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: P(toxic) of each token, and the expected number of steps between two states.

    ``score`` is the log weight of the toxic state per token, ``moves`` the log weights of the transitions; a text begins
    after a clean state. All segments of all texts advance together: first the product of each segment, then along
    the segments of a text, then inside the segments. Every product is scaled, so long texts do not underflow.
    """
    segments = -(-counts // SEGMENT)
    first, total = np.cumsum(segments) - segments, int(segments.sum())
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    place = spread(counts)
    row, column = np.repeat(first, counts) + place // SEGMENT, place % SEGMENT
    weight = np.ones((SEGMENT, total))
    weight[column, row] = np.exp(np.clip(score, -30, 30))
    pad = np.ones((SEGMENT, total), dtype=bool)
    pad[column, row] = False
    some = pad.any(axis=1)
    t = np.exp(moves)

    def ahead(x0: np.ndarray, x1: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        y0, y1 = x0 * t[0, 0] + x1 * t[1, 0], (x0 * t[0, 1] + x1 * t[1, 1]) * weight[j]
        size = y0 + y1
        if size.ndim > 1:
            size = size.sum(axis=0)
        y0 /= size
        y1 /= size
        if some[j]:
            y0, y1 = np.where(pad[j], x0, y0), np.where(pad[j], x1, y1)
        return y0, y1

    # the product of a segment: where it ends after either state before it
    x0, x1 = np.zeros((2, total)), np.zeros((2, total))
    x0[0], x1[1] = 1.0, 1.0
    for j in range(SEGMENT):
        x0, x1 = ahead(x0, x1, j)
    begin, end = np.zeros((2, total)), np.ones((2, total))
    begin[0] = 1.0
    by_length = np.argsort(-segments, kind="stable")
    alive = np.searchsorted(-segments[by_length], -np.arange(1, int(segments.max()) + 1), side="right")
    for k in range(1, len(alive)):
        at = first[by_length[:alive[k]]] + k
        made = np.stack([(begin[:, at - 1] * x0[:, at - 1]).sum(axis=0), (begin[:, at - 1] * x1[:, at - 1]).sum(axis=0)])
        begin[:, at] = made / made.sum(axis=0)
    for k in range(len(alive) - 1, 0, -1):
        at = first[by_length[:alive[k]]] + k
        made = x0[:, at] * end[0, at] + x1[:, at] * end[1, at]
        end[:, at - 1] = made / made.sum(axis=0)
    a = np.empty((SEGMENT + 1, 2, total))
    a[0] = begin
    for j in range(SEGMENT):
        a[j + 1] = ahead(a[j, 0], a[j, 1], j)
    p, pairs = np.empty((SEGMENT, total)), np.zeros((2, 2))
    b = end
    for j in range(SEGMENT - 1, -1, -1):
        heavy = weight[j] * b[1]
        step = np.stack([a[j, 0] * t[0, 0] * b[0], a[j, 0] * t[0, 1] * heavy, a[j, 1] * t[1, 0] * b[0], a[j, 1] * t[1, 1] * heavy])
        step /= step.sum(axis=0)
        p[j] = step[1] + step[3]
        pairs += (step[:, ~pad[j]] if some[j] else step).sum(axis=1).reshape(2, 2)
        made = np.stack([t[0, 0] * b[0] + t[0, 1] * heavy, t[1, 0] * b[0] + t[1, 1] * heavy])
        made /= made.sum(axis=0)
        b = np.where(pad[j], b, made) if some[j] else made
    return p[column, row], pairs


def tag(slots: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Token labels from document labels: tokens with a feature that nearly only toxic documents hold, beyond chance.

    A word or prefix marks its tokens when n toxic and m clean documents hold it, m is at most a quarter of n,
    and n - 2 m documents drawn at random would all be toxic with a probability below 1e-6.
    """
    share = min(max(toxic.mean(), 1e-3), 0.9)
    need = np.log(1e-6) / np.log(share)
    marked = np.zeros(len(slots), dtype=bool)
    for column in range(4):
        pairs = np.unique(np.stack([slots[:, column].astype(np.int64), doc]), axis=1)
        n = np.bincount(pairs[0][toxic[pairs[1]]], minlength=SLOTS)
        m = np.bincount(pairs[0][~toxic[pairs[1]]], minlength=SLOTS)
        marked |= ((n >= need + 2 * m) & (4 * m <= n))[slots[:, column]]
    return marked & toxic[doc]


def fit(data: np.ndarray, cuts: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the slots and the transitions by gradient ascent on the likelihood of the tagged tokens."""
    words = tokens(data, cuts)
    counts = words.counts
    slots = features(words)
    doc = np.repeat(np.arange(len(counts)), counts)
    weights, moves = np.zeros(SLOTS), np.zeros((2, 2))
    if not len(slots) or not toxic.any():
        weights[:] = 0.0
        return weights, np.array([[0.0, -30.0], [0.0, -30.0]])
    gold = tag(slots, doc, toxic)
    place = spread(counts)
    last = np.where(place > 0, np.append(False, gold[:-1]), False)
    seen = np.bincount(2 * last + gold, minlength=4).reshape(2, 2)
    flat = slots.ravel()
    memory, moved = np.zeros(SLOTS), np.zeros((2, 2))
    for _ in range(_ROUNDS):
        p, pair = marginals(weights[slots].sum(axis=1), moves, counts)
        slope = np.bincount(flat, weights=np.repeat(gold - p, slots.shape[1]), minlength=SLOTS) - _DECAY * len(doc) * weights
        turn = seen - pair
        memory += slope ** 2
        moved += turn ** 2
        weights += _STEP * slope / np.sqrt(memory + 1e-12)
        moves += _STEP * turn / np.sqrt(moved + 1e-12)
    return weights, moves


def fitted(labelled: DataFrame, text: str, toxic: str, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Fit in one task on the ``sample`` distinct labelled texts that come first in hash order."""
    def run(table: pa.Table) -> pa.Table:
        weights, moves = fit(*bytes_of(table["_text"]), table["_toxic"].to_numpy().astype(bool))
        return pa.table({"w": [weights.astype("<f4").tobytes()], "m": [moves.astype("<f8").tobytes()]})

    rows = labelled.select(F.col(text).alias("_text"), F.col(toxic).cast("int").alias("_toxic")).where("_toxic is not null")
    # copies teach once: distinct texts (96 bits of them) with a label are chosen by hash alone, then one row of each is read
    keys = ["_hash", "_check", "_toxic"]
    marked = rows.select("*", F.xxhash64("_text").alias("_hash"), F.hash("_text").alias("_check"))
    first = marked.select(*keys).distinct().orderBy(*keys).limit(sample)
    chosen = marked.join(F.broadcast(first), keys).dropDuplicates(keys).select("_text", "_toxic")
    made = chosen.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "w binary, m binary").first()
    if made is None:
        return np.zeros(SLOTS, np.float32), np.array([[0.0, -30.0], [0.0, -30.0]])
    return np.frombuffer(made.w, "<f4"), np.frombuffer(made.m, "<f8").reshape(2, 2)


def toxicity(
    docs: DataFrame,
    labelled: DataFrame,
    text: str = "text",
    toxic: str = "toxic",
    carry: Sequence[str] = ("doc_id",),
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``carry`` columns, score, predicted and the toxic spans of every whole text.

    ``labelled`` holds texts and document labels; at most ``sample`` distinct ones, first in hash order, fit the field
    (a documented bound of the fit alone), each once, however many copies there are. Its tokens are labelled by ``tag``. The score of a document is the highest
    marginal of its tokens, the spans are the byte offsets of neighbouring tokens with a marginal of at least 0.5.
    Texts without tokens (null, empty, symbols) score 0; without toxic labels everything does. Labels that are null
    teach nothing. Only the text enters a score, so repeated rows score alike.
    """
    weights, moves = fitted(labelled, text, toxic, sample)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([
        *[docs.schema[c] for c in carry], StructField("score", DoubleType()), StructField("predicted", IntegerType()),
        StructField("spans", ArrayType(span)),
    ])
    if len({f.name.lower() for f in schema}) < len(schema):
        raise ValueError(f"columns named twice in {schema.names}")
    arrow, carry = to_arrow_schema(schema), list(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                words = tokens(*bytes_of(part.column(text)))
                p, _ = marginals(weights[features(words)].sum(axis=1, dtype=np.float64), moves, words.counts)
                score = np.zeros(part.num_rows)
                has = words.counts > 0
                score[has] = np.maximum.reduceat(p, words.first[:-1][has]) if len(p) else 0.0
                hit = p >= 0.5
                edge = np.zeros(len(p) + 1, dtype=bool)
                edge[words.first] = True
                begin = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
                end = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)))
                of = np.searchsorted(words.first, begin, side="right") - 1
                from_start = words.cuts[of]
                cuts = np.searchsorted(begin, words.first).astype(np.int32)
                pairs = pa.StructArray.from_arrays(
                    [pa.array(words.starts[begin] - from_start), pa.array(words.ends[end] - from_start)], ["start", "end"]
                )
                columns = [
                    *[part.column(c) for c in carry], pa.array(np.clip(score, 0.0, 1.0)), pa.array((score >= 0.5).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cuts), pairs),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)


def sample_keys(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample: int) -> DataFrame:
    """(_hash, _check, _toxic): 96 bits of the distinct labelled texts that come first in hash order; no text moves."""
    marked = docs.select(F.col(doc_id), F.xxhash64(text).alias("_hash"), F.hash(text).alias("_check"))
    known = labels.select(F.col(doc_id), F.col(toxic).cast("int").alias("_toxic")).where("_toxic is not null")
    keys = ["_hash", "_check", "_toxic"]
    return marked.join(known, doc_id).select(*keys).distinct().orderBy(*keys).limit(sample)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE
) -> DataFrame:
    """(text, toxic): the distinct labelled texts that come first in hash order, at most ``sample`` of them.

    The texts are hashed where they are read; only ids and hashes meet the labels, and only the chosen texts are
    read again and written. A text with both labels is there with each. Null labels, and ids on one side only, teach nothing.
    """
    first = pin(sample_keys(docs, labels, doc_id, text, toxic, sample))
    marked = docs.select(F.col(text), F.xxhash64(text).alias("_hash"), F.hash(text).alias("_check"))
    # at most ``sample`` rows of three numbers are broadcast
    chosen = marked.join(F.broadcast(first), ["_hash", "_check"]).dropDuplicates(first.columns)
    return pin(chosen.select(text, F.col("_toxic").alias(toxic)))


def teaching(labels: DataFrame, doc_id: str) -> DataFrame:
    """Labels of the rows that may teach: crc32 of the id as text is not divisible by 5."""
    return labels.where(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0)
