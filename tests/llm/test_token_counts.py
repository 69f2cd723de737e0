"""Token counts against the vocabulary's own library and a plain search over all segmentations."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from ebbtide.llm import registry
from ebbtide.llm.token_counts import Counter, forward_counts, piece_trie, read_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores, segmented as unigram model instead of by merges."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def plain_count(word: str, scores: dict[str, float]) -> int:
    """Every last piece of every prefix, the longest first."""
    unknown = min(scores.values()) - 10.0
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(end):
            piece = word[start:end]
            if piece in scores:
                step = (best[start][0] + scores[piece], best[start][1] + 1)
            elif end - start == 1:
                step = (best[start][0] + unknown, best[start][1] + len(piece.encode()))
            else:
                continue
            if found is None or step[0] > found[0]:
                found = step
        best.append(found)
    return best[-1][1]


def test_forward_counts_equal_the_plain_search():
    choose = random.Random(8)
    for _ in range(60):
        scores = {
            "".join(choose.choice("abcé") for _ in range(choose.randint(1, 4))): float(-choose.randint(1, 6))
            for _ in range(choose.randint(1, 12))
        }
        words = sorted({"".join(choose.choice("abcé漢🙂") for _ in range(choose.randint(0, 12))) for _ in range(60)})
        assert forward_counts(words, piece_trie(scores)).tolist() == [plain_count(w, scores) for w in words]
    assert forward_counts([], piece_trie({"a": -1.0})).tolist() == []
    assert forward_counts(["aé"], piece_trie({})).tolist() == [3]


def test_counts_equal_the_library(spark, library):
    texts = [r.text for r in registry.table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()]
    words = sorted({w for t in texts if t for w in re.findall(r"[^\x20\x09-\x0D]+", t)})
    # its search for the best few, word by word and without unknown characters: its single best path is cut by rounding
    held = []
    for word in (w for w in words[::3] if len(w) < 60):
        found = library.nbest_encode_as_ids(word, 2)
        sums = [sum(map(library.get_score, ids)) for ids in found]
        if sums[0] > max(sums[1:], default=-np.inf) and not any(library.is_byte(i) or library.is_unknown(i) for i in found[0]):
            held.append((word, len(found[0])))
    assert len(held) > 1000
    _, tokens = Counter(read_pieces(PATH)).count([w for w, _ in held])
    assert tokens == [n for _, n in held]


def test_forgetting_changes_nothing():
    texts = ["the cat", None, "", "sat on the mat " * 3, "x" * 3000, "漢字 ▁ \u0085"]
    kept, small = Counter(read_pieces(PATH)), Counter(read_pieces(PATH), remembered=1)
    together = kept.count(texts)
    assert [small.count([t]) for t in texts] == [([a], [b]) for a, b in zip(*together)]
    assert together[0][:3] == [2, 0, 0] and together[1][1:3] == [0, 0]


def test_frames(spark, odd):
    counter = Counter(read_pieces(PATH))
    found = token_counts(odd, PATH, carry=("doc_id", "text"), trie_bytes=64).collect()
    assert len(found) == odd.count()
    for row in found:
        words, tokens = counter.count([row.text])
        assert (row.n_pretokens, row.n_tokens) == (words[0], tokens[0])
    assert token_counts(odd.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_counts(odd.withColumnRenamed("size", "n_tokens"), PATH, carry=("doc_id", "n_tokens"))


def test_query_equals_a_direct_count(spark):
    rows = registry.QUERIES["op8_token_counts"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in registry.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    words, tokens = Counter(read_pieces(PATH)).count(list(texts.values()))
    assert {r.doc_id: (r.n_pretokens, r.n_tokens) for r in rows} == dict(zip(texts, zip(words, tokens)))
    assert np.sum(words) > 0
