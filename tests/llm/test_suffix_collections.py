"""Pieces that agree with no other one beside their minimizer stay out of the transform; every string keeps its smallest owner."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ebbtide.llm import suffix_dedup as module

WIDTH = 50


def test_only_pieces_that_can_share_a_string_are_transformed(monkeypatch):
    rng = np.random.default_rng(7)
    letters = lambda n: "".join(rng.choice(list("abcd"), n))
    parts = [letters(int(n)) for n in (18, 30, 34, 49, 50, 51, 66, 70, 90)]
    texts = [letters(20) + parts[i % 9] + letters(15) + parts[i * 7 % 9] + letters(5) for i in range(150)]
    texts += ["ab" * 60, "b" + "ab" * 60, texts[3], texts[3][10:]]
    ids = rng.permutation(len(texts))
    own = module._Pieces(pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["_id", "_text"]), WIDTH)
    size, begin, body = own.windows + WIDTH - 1, own.starts[own.first], own.data.tobytes()
    holders, least_id = {}, {}
    for a, n, i in zip(begin.tolist(), size.tolist(), own.ids[own.docs].tolist()):
        piece = body[a:a + n]
        holders.setdefault(piece, []).append((i, a))
        for k in range(n - WIDTH + 1):
            least_id[piece[k:k + WIDTH]] = min(i, least_id.get(piece[k:k + WIDTH], i))
    place = {a: at for at, a in enumerate(begin.tolist())}
    heads = np.array([place[own_[0][1]] for own_ in holders.values()])
    owner = np.array([min(i for i, _ in own_) for own_ in holders.values()])
    moved, transform = [], module.collection_transform
    monkeypatch.setattr(module, "collection_transform", lambda data, cuts, cap: moved.append(len(cuts) - 1) or transform(data, cuts, cap))
    least, first = module.least_owners(own.data, begin[heads], size[heads], own.seeds[heads], owner, WIDTH)
    for piece, at in zip(holders, first.tolist()):
        strings = [piece[k:k + WIDTH] for k in range(len(piece) - WIDTH + 1)]
        assert least[at:at + len(strings)].tolist() == [least_id[x] for x in strings]
    # the strings of most pieces are in no other piece
    shared = sum(any(sum(p.find(piece[k:k + WIDTH]) >= 0 for p in holders) > 1 for k in range(len(piece) - WIDTH + 1)) for piece in holders)
    assert 0 < shared <= moved[0] < len(holders)
