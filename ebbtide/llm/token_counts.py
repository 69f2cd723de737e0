"""Unigram token counts by a forward pass over a trie of the distinct pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ebbtide.llm.blocks import slices

#: Text whose new pre-tokens share one trie.
TRIE_BYTES = 4 << 20
#: A worker forgets its counts when it holds so many pre-tokens; they are then counted again.
REMEMBERED = 500_000
#: How far an unknown character lies below the least score of any piece, as in the vocabulary's own library.
UNKNOWN_BELOW = 10.0
_CHAR_BITS = 21
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = "▁"


@dataclass
class Pieces:
    """The vocabulary as a trie: sorted (state, character) keys, the states they lead to and the score of each state's piece."""

    keys: np.ndarray
    to: np.ndarray
    score: np.ndarray
    unknown: float
    longest: int

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next states, -1 where no piece goes on; a state of -1 stays."""
        out = np.full(states.shape, -1, dtype=np.int64)
        live = np.flatnonzero(states >= 0)
        keys = states[live] << _CHAR_BITS | chars[live]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        out[live[hit]] = self.to[at[hit]]
        return out


def piece_trie(scores: dict[str, float]) -> Pieces:
    """The trie of pieces and their scores; without pieces every character is unknown."""
    edges: dict[int, int] = {}
    ends = [-np.inf]
    for piece, score in scores.items():
        state = 0
        for char in piece:
            key = state << _CHAR_BITS | ord(char)
            if key not in edges:
                edges[key] = len(ends)
                ends.append(-np.inf)
            state = edges[key]
        ends[state] = score
    keys = np.array(sorted(edges) or [-1], dtype=np.int64)
    to = np.array([edges.get(k, -1) for k in keys.tolist()], dtype=np.int64)
    return Pieces(keys, to, np.array(ends), min(scores.values(), default=0.0) - UNKNOWN_BELOW, max(map(len, scores), default=1))


@cache
def read_pieces(path: str) -> Pieces:
    """The ordinary pieces of a model file and their scores; control, unknown and byte pieces match no text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [
        i for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]
    return piece_trie({model.id_to_piece(i): model.get_score(i) for i in plain})


def forward_counts(words: Sequence[str], pieces: Pieces) -> np.ndarray:
    """How many tokens the best segmentation of each distinct word has.

    The words form a trie that is built level by level: a node is a distinct (parent, character). Its best score is that of an
    ancestor plus the piece between them, over all pieces that end here; equal scores take the longest last piece. Each node is
    scored once, whatever the number of words through it, and carries the scores, counts and open matches of its last
    ``longest`` ancestors, so memory holds one level only. A word's count is read where it ends.
    """
    size = np.array([len(w) for w in words], dtype=np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    first = np.cumsum(size) - size
    out = np.zeros(len(words), dtype=np.int64)
    active = np.flatnonzero(size > 0)
    node = np.zeros(len(active), dtype=np.int64)
    width = pieces.longest
    # of the nodes of the last level: states of the matches that began 1, 2, .. characters ago; scores and counts 0, 1, .. above
    state = np.full((1, width), -1, dtype=np.int64)
    best = np.full((1, width), -np.inf)
    best[0, 0] = 0.0
    count = np.zeros((1, width), dtype=np.int64)
    depth = 0
    while len(active):
        keys, node = np.unique(node << _CHAR_BITS | chars[first[active] + depth], return_inverse=True)
        parent, char = keys >> _CHAR_BITS, keys & ((1 << _CHAR_BITS) - 1)
        begun = np.concatenate([np.zeros((len(keys), 1), np.int64), state[parent, :-1]], axis=1)
        state = pieces.step(begun.ravel(), np.repeat(char, width)).reshape(begun.shape)
        above, counted = best[parent], count[parent]
        reached = above + np.where(state >= 0, pieces.score[np.maximum(state, 0)], -np.inf)
        alone = pieces.score[np.maximum(state[:, 0], 0)] == -np.inf
        reached[alone, 0] = above[alone, 0] + pieces.unknown
        length = width - 1 - reached[:, ::-1].argmax(axis=1)
        line = np.arange(len(keys))
        # an unknown character is spelt in its UTF-8 bytes
        spelt = 1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF)
        tokens = counted[line, length] + np.where(alone & (length == 0), spelt, 1)
        best = np.concatenate([reached[line, length][:, None], above[:, :-1]], axis=1)
        count = np.concatenate([tokens[:, None], counted[:, :-1]], axis=1)
        depth += 1
        over = size[active] == depth
        out[active[over]] = tokens[node[over]]
        active, node = active[~over], node[~over]
    return out


class Counter:
    """Counts the tokens of texts; terminal counts of the pre-tokens seen are kept, up to ``remembered``."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        self.pieces, self.remembered = pieces, remembered
        self.known: dict[str, int] = {}

    def count(self, texts: Sequence[str | None]) -> tuple[list[int], list[int]]:
        """The pre-tokens and the tokens of every text."""
        found = [_WORD.findall(t) if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.known.clear()
        fresh = sorted(set().union(*found) - self.known.keys())
        self.known.update(zip(fresh, forward_counts([_SPACE + w for w in fresh], self.pieces).tolist()))
        return [len(f) for f in found], [sum(map(self.known.__getitem__, f)) for f in found]


def token_counts(
    docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] = ("doc_id",), trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """The ``carry`` columns, n_pretokens and n_tokens of every whole text under a unigram model.

    A pre-token is a maximal run of characters other than space and the control characters 9 to 13, behind the mark of a
    word's begin. Its tokens are the pieces of ``path`` (a model file that every machine holds) with the greatest sum of the
    file's scores; equal sums take the longest last piece. A character that is no piece counts its UTF-8 bytes and scores
    ``UNKNOWN_BELOW`` under the least piece. Null, empty and blank texts have 0 of both. Rows stay as they are, repeated or not,
    and no other column takes part. Nothing is shuffled: a hot source or repeated text costs what its rows cost. A pre-token
    without end takes one level of the trie per character, in constant memory besides its own text.
    """
    carry = list(carry)
    schema = StructType([*[docs.schema[c] for c in carry], StructField("n_pretokens", LongType()), StructField("n_tokens", LongType())])
    if len({f.name.lower() for f in schema}) < len(schema):
        raise ValueError(f"columns named twice in {schema.names}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(read_pieces(path))
        for batch in batches:
            for part in slices(batch, text, trie_bytes):
                words, tokens = counter.count(part.column(text).to_pylist())
                columns = [*[part.column(c) for c in carry], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.select(*dict.fromkeys([*carry, text])).mapInArrow(run, schema)
