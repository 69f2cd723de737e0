"""Folding of whole texts against Python, and its cost."""

from __future__ import annotations

import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.functions import text


def folded(value):
    other = {"А": "A", "а": "a"}
    plain = "".join(other.get(c) or unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in value or "")
    return re.sub("[^a-z0-9]+", " ", plain.lower()).strip(" ")


def samples():
    rng = np.random.default_rng(12)
    odd = list(" ab-Z9é ½ﬁАж中①Ａ—\n\x00") + ["\U0001f600", "\U0001d7d9", "\U0001f100"]
    made = ["".join(rng.choice(odd, n)) for n in rng.integers(0, 30, 4000)]
    return [None, "", " ", "½", "-", *made, *(f"{c} b" for c in text.SEVERAL), *(f"{c}q" for c in text.ACCENTED)]


@pytest.mark.parametrize("step", [16, 1 << 20])
def test_folding_against_python(monkeypatch, step):
    monkeypatch.setattr(text, "FOLD_BYTES", step)
    values = samples()
    want = [folded(v) for v in values]
    assert text._plain_names(pa.array(values)).to_pylist() == want
    assert text._plain_names(pa.array(["x", *values, "y"]).slice(1, len(values))).to_pylist() == want
    assert text._plain_names(pa.array([], pa.string())).to_pylist() == []


def test_texts_are_folded_in_time(spark):
    """16 MB of accented text: with the characters in a pattern it took longer than the limit here."""
    rows = spark.range(800, numPartitions=8).select("id", F.repeat(F.lit("Kŭrdzhali (stolitsa), ½ "), 800).alias("t"))
    began = time.monotonic()
    found = rows.select(text.plain_name("t").alias("n")).groupBy("n").count().collect()
    assert [(r.n, r["count"]) for r in found] == [(" ".join(["kurdzhali stolitsa 12"] * 800), 800)]
    assert time.monotonic() - began < 12
