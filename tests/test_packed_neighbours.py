"""Packed blocks against brute force and against cells; what is written for a search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from ebbtide import session
from ebbtide.operators import neighbours as nn


def blocks_of(x, ids, known=None, kinds=None):
    known = np.ones(len(ids), bool) if known is None else known
    return nn.Block(np.asarray(ids), known, x, np.zeros((len(ids), 0), np.int64) if kinds is None else kinds)


def plain(queries, base, k, itself, penalty=0.0):
    out = []
    for i, row in enumerate(queries.vectors):
        far = np.sqrt(((base.vectors - row) ** 2).sum(1) + (penalty * (base.kinds != queries.kinds[i]).sum(1) if penalty else 0))
        out.append([(int(base.ids[j]), far[j]) for j in np.lexsort((base.ids, far)) if not (itself and base.ids[j] == queries.ids[i])][:k])
    return out


@pytest.mark.parametrize("case", ["random", "offset", "tiny", "large", "ties", "kinds", "twice"])
@pytest.mark.parametrize("itself", [True, False])
def test_blocks_against_brute_force(case, itself, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (700, 7))
    x[300:350] = x[:50]
    kinds, penalty, ids = None, 0.0, rng.permutation(700) - 350
    if case == "offset":
        x = 1e7 + x
    if case in ("tiny", "large"):
        x = x * (1e-25 if case == "tiny" else 1e25)
    if case == "ties":
        x = np.round(x[:, :2])
    if case == "kinds":
        kinds, penalty = rng.integers(0, 3, (700, 2)), 2.5
    if case == "twice":
        ids[350:] = ids[:350]
    whole = blocks_of(x, ids, kinds=kinds)
    monkeypatch.setattr(nn, "COMPARE", 1 << 12)
    best = nn.Nearest(whole, 5, itself, penalty)
    for at in (0, 3, 130, 400):
        part = slice(at, {0: 3, 3: 130, 130: 400, 400: 700}[at])
        best.meet(blocks_of(x[part], ids[part], kinds=None if kinds is None else kinds[part]))
    found = best.found().to_pandas()
    want = [(int(ids[i]), n, far) for i, near in enumerate(plain(whole, whole, 5, itself, penalty)) for n, far in near]
    assert list(found["id"]) == [w[0] for w in want]
    assert list(found["neighbour"]) == [w[1] for w in want]
    assert np.array_equal(found["distance"], [w[2] for w in want])


def test_equal_rows_keep_their_smallest_ids():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(0, 1, (3, 4)), [200, 3, 1], axis=0)
    ids = rng.permutation(204)
    ids[:40] = ids[40]
    kept = nn._smallest(ids, np.ones(204, bool), x, np.zeros((204, 0), np.int64), 5)
    assert len(kept) <= 5 * 6 + 4 and set(range(200, 204)) <= set(kept.tolist())
    queries = blocks_of(x, ids)
    assert plain(queries, blocks_of(x[kept], ids[kept]), 5, True) == plain(queries, queries, 5, True)


@pytest.mark.parametrize("numbers", [2, 12])
def test_cells_and_packed_blocks_agree(spark, monkeypatch, numbers):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(900) // 2, "vec": rng.normal(0, 1, (900, numbers)).round(1).tolist()}))
    monkeypatch.setattr(nn, "PASS_BYTES", 20_000)
    found = []
    for few, visits in ((0, float("inf")), (0, -1), (1 << 32, 0)):
        monkeypatch.setattr(nn, "FEW_PAIRS", few)
        monkeypatch.setattr(nn, "VISITS", visits)
        near = nn.nearest(rows, rows, 4, row_id="id", vector="vec", itself=True, block_rows=64).collect()
        found.append(sorted((r.id, r.place, r.neighbour, r.distance) for r in near))
    assert found[0] == found[1] == found[2] and len(found[0]) == 4 * 450


def test_a_row_is_written_once_whatever_it_meets(spark, monkeypatch):
    """Random rows of 40 dimensions visit nearly all cells; a copy for every visit was written before."""
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "vec": rng.normal(0, 1, (3000, 40)).tolist()}))
    pinned, pin = [], session.pin

    def counting(frame):
        out = pin(frame)
        size = sum(out.rdd.map(lambda r: sum(len(v) * (8 if isinstance(v, list) else 1) if isinstance(v, (list, bytearray)) else 8 for v in r)).collect())
        pinned.append(size)
        return out

    monkeypatch.setattr(nn, "pin", counting)
    assert nn.nearest(rows, rows, 3, row_id="id", vector="vec", itself=True).count() == 9000
    assert sum(pinned) < 4 * 3000 * 41 * 8


def test_tomek_links_search_once(spark):
    """Both sides of the mutual join read one result: the search itself is not in the plan again."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 3))
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(200), "vec": x.tolist(), "y": np.arange(200) % 2}))
    links = nn.tomek_links(rows, "id", "vec", "y")
    plan = links._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "CartesianProduct" not in plan
    near = {i: n[0][0] for i, n in enumerate(plain(blocks_of(x, np.arange(200)), blocks_of(x, np.arange(200)), 1, True))}
    want = {(i, j) for i, j in near.items() if near[j] == i and i < j and (i - j) % 2}
    assert {(r.id, r.neighbour) for r in links.collect()} == want
