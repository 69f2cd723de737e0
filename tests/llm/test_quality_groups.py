"""A group of documents costs what its text costs, however many batches of the input it was dealt from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ebbtide.llm.blocks import encode
from ebbtide.llm.quality_classifier import KneserNey, distinct_keys, merged, perplexity


def test_small_payloads_are_merged():
    rows = [{"id": i, "text": None if i % 7 == 0 else f"row {i} " * (i % 5)} for i in range(900)]
    rows[450]["text"] = "long " * 4000
    payloads = pa.array([encode(pa.RecordBatch.from_pylist([r], pa.schema([("id", pa.int64()), ("text", pa.string())]))) for r in rows], pa.binary())
    parts = list(merged(payloads, "text", 4096))
    assert [r for part in parts for r in part.to_pylist()] == rows
    # a payload of its own made 900 sorts of all grams found so far; text of 12 kB and one long text is a few batches
    assert len(parts) < 20
    assert list(merged(payloads[:0], "text", 4096)) == []


def test_distinct_numbers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        keys = rng.integers(0, 700, n).astype(np.uint64)
        keys[: n // 9] = np.uint64(2**64 - 1)
        assert np.array_equal(distinct_keys(keys), np.unique(keys))


def test_perplexity_follows_the_text_and_not_the_batches(spark, monkeypatch):
    from ebbtide.llm import quality_classifier

    monkeypatch.setattr(quality_classifier, "GROUP_BYTES", 8000)
    rows = [(i if i % 11 else None, None if i % 13 == 0 else f"some words of text {i * i} and {i % 9} " * (1 + i % 4)) for i in range(600)]
    model = KneserNey(spark.createDataFrame(rows[:300], "id long, text string"), "text")
    found = []
    for parts in (1, 40):
        docs = spark.createDataFrame(rows, "id long, text string").repartition(parts)
        found.append(sorted(((r.id or -1, r.n_bytes, round(r.logp, 6)) for r in perplexity(docs, model, "text", "id", []).collect())))
    assert found[0] == found[1] and len(found[0]) == 600
    assert all(n == 0 or p < 0 for _, n, p in found[0])
