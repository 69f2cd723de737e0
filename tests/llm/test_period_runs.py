"""Periodic runs against brute force: random sequences, odd rows, and the registered query on whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from ebbtide.llm import registry
from ebbtide.llm.period_runs import period_runs, runs_of, squares

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(values, least):
    """Maximal stretches of every period, those of a smaller period left out."""
    found = {}
    for period in range(1, len(values) // 2 + 1):
        at = 0
        while at + period < len(values):
            end = at
            while end + period < len(values) and values[end] == values[end + period]:
                end += 1
            if end - at + period >= max(least, 2 * period):
                found.setdefault((at, end + period - at), period)
            at = end + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def plain_collapsed(values, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(values) if i not in gone)


def tailed(doc, values):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not values:
        return values
    n, g = len(values), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [values[i if i < a else a + (i - a) % p] for i in range(n)]


def test_random_sequences():
    pick = random.Random(7)
    for _ in range(600):
        values = [pick.randrange(pick.randint(1, 4)) for _ in range(pick.randint(0, 50))]
        if values and pick.random() < 0.5:
            a, p = pick.randrange(len(values)), pick.randint(1, 9)
            values = [values[i if i < a else a + (i - a) % p] for i in range(len(values))]
        for least in (1, 3, 12):
            assert runs_of(values, least) == plain_runs(values, least)


def test_squares_end_where_two_periods_do():
    assert list(squares([5, 5, 5])) == [(1, 1), (2, 1)]
    assert list(squares([1, 2, 1, 2, 1])) == [(3, 2), (4, 2)]


@pytest.fixture(scope="module")
def periodic(odd, documents):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    pick = random.Random(3)
    for doc in range(100, 160):
        values = [f"w{pick.randrange(pick.choice((2, 5, 400)))}" for _ in range(pick.randint(0, 90))]
        part = values[: pick.randint(1, 15)]
        rows.append((doc, "\t ".join(values + part * pick.randint(0, 5) + values[::-1]), "a"))
    rows += [(200, "a b  c\nd " * 9000, "a"), (201, "x " * 11, "a"), (202, "x " * 12, "a"), (203, "é\x00 é\x00 " * 6 + "é", "b")]
    # the two halves of a square are alike but for the last word; runs of two periods overlap
    rows += [(204, "a b c d e f a b c d e g", "a"), (205, "a b a b a b a a b a a b a a b a a b c " * 2, "a"), (200, "z", None)]
    return documents(rows)


@pytest.mark.parametrize("least", [12, 5, 1])
def test_rows(periodic, least):
    expected = []
    for r in periodic.collect():
        if least == 1 and len(r.text or "") > 20000:
            continue
        own = words(r.text)
        runs = [(0, len(own), 4)] if r.doc_id == 200 and len(own) > 1 else [] if r.doc_id in (6, 7) else plain_runs(own, least)
        expected.append((r.doc_id, "en", len(own), runs, plain_collapsed(own, runs)))
    rows = periodic.where("length(text) <= 20000 or text is null") if least == 1 else periodic
    found = period_runs(rows, carry=("doc_id", "lang"), least=least).collect()
    got = [(r.doc_id, r.lang, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_no_rows_and_names(odd):
    assert period_runs(odd.limit(0)).count() == 0
    assert period_runs(odd.withColumnRenamed("payload", "runs")).columns == ["doc_id", "n_words", "runs", "collapsed"]
    with pytest.raises(ValueError, match="n_words"):
        period_runs(odd.withColumnRenamed("size", "n_words"), carry=("n_words",))


def digest_row(doc, text):
    own = tailed(doc, words(text))
    runs = plain_runs(own, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha(lines), sha(plain_collapsed(own, runs)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_its_table(spark):
    found = registry.op11_period_runs(spark, SMALL)
    assert found.columns == COLUMNS
    docs = registry.table(spark, SMALL, "documents").select("doc_id", "text").collect()
    expected = [digest_row(r.doc_id, r.text) for r in docs]
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in found.collect())
    assert sum(r[1] > 0 for r in expected) > 10


def test_query_on_odd_rows(spark, odd, tmp_path):
    rows = odd.where("doc_id not in (6, 7) or doc_id is null")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.op11_period_runs(spark, str(tmp_path)).collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(repr(digest_row(r.doc_id, r.text)) for r in rows.collect())
