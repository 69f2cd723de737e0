"""The rows of each stage of the pipeline against brute force, with repeated rows, repeated ids and rows without id."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def one_of_each(rows):
    """Rows (id, text) without near copies: the smallest id of a component, none after all others."""
    sets = [shingles(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for i, (doc, text) in enumerate(rows):
        best.setdefault(find(i), []).append((doc is None, doc or 0, i))
    return [rows[min(group)[2]] for group in best.values()]


def test_one_row_of_every_component_stays(spark, documents, odd):
    passage = " ".join(f"good{i}" for i in range(50))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(20, passage), (20, passage), (None, passage), (None, passage + " more"), (30, " ".join("abcdefgh")), (30, "other " * 3)]
    rows += [(None, "no id and no copy"), (None, "NO id and no copy"), (None, None)]
    found = corpus_pipeline.near_duplicates(spark, documents([(i, t, "a") for i, t in rows]), "")
    assert found.columns == list(corpus_pipeline.COLUMNS)
    kept = [(r.doc_id, r.text) for r in found.collect()]
    lower = lambda pairs: Counter((i, None if t is None else t.lower()) for i, t in pairs)
    assert lower(kept) == lower(one_of_each(rows))
    # nothing of what stays is a copy of another row, so the next stage leaves whole texts
    cut = corpus_pipeline.repeated_passages(spark, documents([(i, t, "a") for i, t in kept if i != 6 and i != 1]), "").collect()
    assert (20, passage) in [(r.doc_id, r.text) for r in cut]


def test_mixed_rows_are_those_the_mix_takes(spark, documents, odd):
    from ebbtide.llm.mixing import mix

    rows = [(r.doc_id, r.text, r.source) for r in odd.collect() if r.doc_id not in (6, 7)]
    rows += [(40, " ".join("abcdefg"[:n]), "a") for n in (2, 3, 5)] + [(None, " ".join("hijklmnop"[:n]), "b") for n in (2, 4, 7)]
    rows += [(40, "x y z", "b"), (40, "x y z", "c")]
    docs = documents(rows)
    want = Counter()
    for r in mix(docs).collect():
        want[r.doc_id, r.source, r.size] += r.taken
    found = Counter()
    for r in corpus_pipeline.source_mix(spark, docs, "").collect():
        assert (r.doc_id, r.text, r.source) in rows and r.lang == "en" and r.n_chars == len(r.text)
        found[r.doc_id, r.source, len(words(r.text))] += len(words(r.text))
    assert +want == found and any(doc is None for doc, _, _ in found)
    assert corpus_pipeline.source_mix(spark, docs.limit(0), "").count() == 0


def test_quality_judges_rows(spark, documents, monkeypatch):
    def judge(docs, trusted, carry=()):
        return docs.selectExpr("doc_id", "lang", "coalesce(text not like '%scum%', true) as kept", *carry)

    monkeypatch.setattr(corpus_pipeline, "quality_scores", judge)
    rows = [(1, "clean", "a"), (1, "scum", "a"), (1, "scum", "b"), (None, "scum", "a"), (None, "clean", "a"), (2, None, "a"), (None, None, "a")]
    found = corpus_pipeline.quality(spark, documents(rows), "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in found) == Counter(r for r in rows if r[1] != "scum")
