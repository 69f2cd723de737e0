"""Substring and suffix deduplication, similarity links and rules against brute force on odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from compare import differences, duck

from ebbtide.llm import registry

SMALL = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_statement(spark, name):
    assert differences(registry.QUERIES[name](spark, SMALL), duck(SMALL), registry.SQL[name]) == ""


def test_substring_dedup(odd):
    from ebbtide.llm.substring_dedup import joined_words, substring_dedup

    rows = [(r.doc_id, words(r.text)) for r in odd.collect()]
    seen = Counter(tuple(w[i:i + 35]) for _, w in rows for i in range(len(w) - 34))
    expected = []
    for doc, w in rows:
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        expected.append((doc, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    for block in (1 << 20, 100):
        found = substring_dedup(odd, carry=("lang",), block_bytes=block).select("doc_id", "n_words", "n_removed", joined_words())
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))
    assert substring_dedup(odd.limit(0)).count() == 0


def test_suffix_dedup(odd):
    from ebbtide.llm.suffix_dedup import suffix_dedup

    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    key = lambda doc: 1 << 62 if doc is None else doc
    first = {}
    for doc, data in rows:
        for i in range(len(data) - 49):
            first[data[i:i + 50]] = min(first.get(data[i:i + 50], 1 << 63), key(doc))
    expected = []
    for doc, data in rows:
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - 49):
            if first[data[i:i + 50]] < key(doc):
                gone[i:i + 50] = True
        gone = gone[:len(data)]
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(data) else 0
        expected.append((doc, len(data), int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
    found = suffix_dedup(odd, carry=("size",)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(repr((*r[:4], bytes(r[4]))) for r in found) == sorted(map(repr, expected))
    assert suffix_dedup(odd.limit(0)).count() == 0


def test_transform_against_sorted_suffixes():
    from ebbtide.llm.suffix_dedup import collection_transform

    random = np.random.default_rng(5)
    for _ in range(30):
        texts = [bytes(random.integers(97, 100, random.integers(0, 9)).astype(np.uint8)) for _ in range(12)]
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        bwt, lcp = collection_transform(np.frombuffer(b"".join(texts), np.uint8), cuts, 4)
        suffixes = sorted((t[i:], n, i) for n, t in enumerate(texts) for i in range(len(t) + 1))
        assert [t[i - 1] if i else 255 for (_, n, i) in suffixes for t in [texts[n]]] != [] and len(bwt) == len(suffixes)
        for (x, *_), (y, *_), size in zip(suffixes, suffixes[1:], lcp[1:]):
            common = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert min(common, 4) == size


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(documents, odd, width, percent):
    from ebbtide.llm.jaccard_join import jaccard_components

    random = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect() if r.doc_id != 6 and r.doc_id != 7]
    for doc in range(100, 160):
        own = list(base)
        for place in random.integers(0, 80, random.integers(0, 6)):
            own[place] = f"n{random.integers(0, 9999)}"
        rows.append((doc, " ".join(own), "a"))

    def grams(text):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    sets = {doc: grams(text) for doc, text, _ in rows if doc is not None}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = jaccard_components(documents(rows), width=width, percent=percent, block_bytes=2000).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), find(r.doc_id))


def test_jaccard_of_no_rows(odd):
    from ebbtide.llm.jaccard_join import jaccard_components

    assert jaccard_components(odd.limit(0)).count() == 0


def test_quality_rules(odd):
    from ebbtide.llm.quality_rules import quality_rules

    found = {repr(r.doc_id): r for r in quality_rules(odd).collect()}
    assert found["3"].n_words == 0 and found["3"].base_failed and not found["3"].kept
    assert found["11"].n_repeat_words == 200 and found["11"].base_failed
    assert found["1"].kept and found["1"].n_words == 60 and found["8"].word_chars == len("é漢字scumfoo")
    assert quality_rules(odd).count() == odd.count() and quality_rules(odd.limit(0)).count() == 0


def test_lines_above_the_limit(documents):
    from ebbtide.llm.quality_rules import quality_rules

    rows = [(i, f"Read   the terms now\nown {' '.join(f'x{i}y{k}' for k in range(12))}", "h") for i in range(30)]
    rows += [(99, "read the terms now\nread the terms now", "h"), (100, "read the terms now\n" + "z " * 12, "other")]
    found = {r.doc_id: r for r in quality_rules(documents(rows), least_words=5).collect()}
    assert found[0].n_line_words == 4 and found[0].kept and found[0].text.startswith("own")
    assert found[99].n_line_words == 8 and not found[99].kept and found[100].n_line_words == 0


def test_digest_of_kept_text(spark, odd):
    row = registry.op1_substring_dedup(spark, SMALL).where("n_removed = 0").first()
    text = registry.table(spark, SMALL, "documents").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()
