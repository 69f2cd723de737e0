"""Encoding, mixing, search and the two classifiers against libraries, brute force and held-out labels."""

from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ebbtide.llm import registry

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from ebbtide.llm.bpe import vocabulary

    whole = vocabulary(RANKS, public_tokenizers.PATTERN).whole
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=whole, special_tokens={})


def test_encoding_equals_the_library(library):
    from ebbtide.llm.bpe import Encoder, decode_ids, vocabulary

    choose = random.Random(4)
    letters = ["a", "b", "the", " ", "  ", "\n", "é", "1", "'s", "!", "\u0085", "\x1c", "漢", "🙂", "\t", "²", "-"]
    texts = ["".join(choose.choice(letters) for _ in range(choose.randint(0, 40))) for _ in range(2000)]
    texts += [None, "", "a" * 5000, "ab" * 700, " " * 999, "".join(choose.choice("abcdehimnorst") for _ in range(4000))]
    encoder = Encoder(vocabulary(RANKS, public_tokenizers.PATTERN))
    ids, cuts = encoder.encode(texts)
    data, ends = decode_ids(ids, cuts, encoder.vocab)
    for i, text in enumerate(texts):
        assert ids[cuts[i]:cuts[i + 1]].tolist() == library.encode_ordinary(text or "")
        assert data[ends[i]:ends[i + 1]].tobytes() == (text or "").encode()


def test_round_trip_through_frames(odd):
    from ebbtide.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip

    coded = bpe_encode(odd, RANKS, public_tokenizers.PATTERN, carry=("doc_id", "text"))
    back = bpe_decode(coded, RANKS, public_tokenizers.PATTERN, carry=("doc_id", "text"))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe_round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_budgets_are_fitted():
    from ebbtide.llm.mixing import fit_lengths

    draw = np.random.default_rng(0)
    for _ in range(100):
        lengths = np.unique(draw.integers(1, 50, draw.integers(1, 9)))
        counts = draw.integers(1, 5, len(lengths))
        budget = int(draw.integers(0, (lengths * counts).sum() + 1))
        take = fit_lengths(lengths, counts, budget)
        sums = {0}
        for length, count in zip(lengths, counts):
            sums = {s + length * k for s in sums for k in range(count + 1)}
        assert (take >= 0).all() and (take <= counts).all()
        assert abs((take * lengths).sum() - budget) == min(abs(s - budget) for s in sums)


def test_mix(odd):
    from ebbtide.llm.mixing import mix

    rows = mix(odd).collect()
    assert len(rows) == odd.count() and sorted(map(repr, rows)) == sorted(map(repr, mix(odd).collect()))
    for name in {r.source for r in rows}:
        own = [r for r in rows if r.source == name]
        assert all(r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert own[0].target <= 3 * own[0].source_size
    assert mix(odd.limit(0)).count() == 0


def test_search_of_odd_vectors(spark):
    from ebbtide.llm.vector_search import top_k

    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=6).tolist()) for i in range(200)] + [(i, [1.0] * 6) for i in range(200, 320)]
    rows += [(400, None), (450, [1.0, None] * 3), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (None, [1.0] * 6), (600, [2.0] * 3)]
    found = {}
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=64).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows[:320]]
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
            assert sorted(found[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(found) == {0, 50, 100, 150, 200, 250, 300}


def test_marginals_against_all_paths():
    from ebbtide.llm.toxicity import marginals

    draw = np.random.default_rng(0)
    score, moves = draw.normal(size=7), draw.normal(size=(2, 2))
    total, toxic = 0.0, np.zeros(7)
    for path in itertools.product((0, 1), repeat=7):
        weight = sum(moves[a, b] for a, b in zip((0, *path), path)) + sum(s for s, b in zip(score, path) if b)
        total += np.exp(weight)
        toxic += np.exp(weight) * np.array(path)
    p, _ = marginals(np.concatenate([score, score]), moves, np.array([7, 0, 7]))
    assert np.allclose(p, np.tile(toxic / total, 2))


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    found = registry.op5_toxicity(spark, folder).where("held_out").join(registry.table(spark, folder, "labels"), "doc_id").collect()
    hits = sum(r.predicted == r.toxic == 1 for r in found)
    assert hits >= 0.8 * sum(r.toxic for r in found) and hits >= 0.8 * sum(r.predicted for r in found)


def test_toxicity_of_odd_rows(odd):
    from ebbtide.llm.toxicity import toxicity

    labelled = odd.selectExpr("text", "0 as toxic")
    assert {r.predicted for r in toxicity(odd, labelled).collect()} == {0}
    assert toxicity(odd.limit(0), labelled.limit(0)).count() == 0


def test_kneser_ney_sums_to_one_and_separates(spark):
    from ebbtide.llm.quality_classifier import KneserNey, quality_scores

    texts = spark.createDataFrame([("the cat sat on the mat",), ("a cat and a hat",)], "text string")
    model = KneserNey(texts, "text")
    context = int.from_bytes(b" the", "big") << 8
    grams = spark.range(256).selectExpr(f"cast({context} as bigint) + id as gram", "0 as _group")
    assert abs(sum(np.exp(r.logp) for r in model.log_probability(grams).collect()) - 1) < 1e-3
    folder = "/root/testdata/sf0.01"
    found = registry.op10_quality_classifier(spark, folder).join(registry.table(spark, folder, "labels"), "doc_id").collect()
    assert sum(r.kept for r in found if r.quality == 1) >= 0.99 * sum(r.quality for r in found)
    assert sum(not r.kept for r in found if r.quality == 0) >= 0.8 * sum(1 - r.quality for r in found)
    docs = registry.table(spark, folder, "documents")
    nobody = quality_scores(docs.limit(20), registry.trusted_ids(spark, folder).limit(0))
    assert all(r.kept for r in nobody.collect())


def test_perplexity_against_counts_in_python(spark):
    from ebbtide.llm.quality_classifier import ORDER, KneserNey, perplexity

    trusted = ["the cat sat on the mat", "a cat and a hat", "the rat sat"]
    asked = [(1, "the hat sat on a cat"), (2, "zzz"), (3, ""), (4, None), (None, "the mat"), (4, "the mat")]
    model = KneserNey(spark.createDataFrame([(t,) for t in trusted], "text string"), "text")
    lead = b"\n" * (ORDER - 1)
    counts = {ORDER: collections.Counter((lead + t.encode())[i:i + ORDER] for t in trusted for i in range(len(t)))}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])

    def cut(n, c):
        return model.discounts[n][min(c, 3) - 1]

    def probability(gram):
        p = 1 / 256
        for n in range(1, ORDER + 1):
            last = gram[-n:]
            same = {g: c for g, c in counts[n].items() if g[:-1] == last[:-1]}
            if same:
                own = counts[n][last] - cut(n, counts[n][last]) if last in same else 0
                p = (own + sum(cut(n, c) for c in same.values()) * p) / sum(same.values())
        return p

    docs = spark.createDataFrame(asked, "doc_id long, text string")
    found = perplexity(docs, model, "text", "doc_id", []).collect()
    want = [(i, len(t or ""), sum(np.log(probability((lead + t.encode())[k:k + ORDER])) for k in range(len(t))) if t else 0.0) for i, t in asked]
    key = lambda row: (str(row[0]), row[1])
    for got, (i, n, logp) in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert (got.doc_id, got.n_bytes) == (i, n) and abs(got.logp - logp) < 1e-3


def test_quality_of_odd_rows(odd):
    from ebbtide.llm.quality_classifier import quality_scores

    found = quality_scores(odd, odd.select("doc_id")).collect()
    assert len(found) == odd.count() and all(r.kept for r in found if not r.n_bytes)
    assert quality_scores(odd.limit(0), odd.select("doc_id").limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    result = corpus_pipeline.run(spark, SMALL)
    assert set(result.columns) == {"doc_id", "lang", "source", "n_tokens", "ids"} and result.count() > 0
