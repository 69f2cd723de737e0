"""The line rule of the quality query: against its statement on a fixture where lines go, and against Python on odd rows."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
from compare import canonical

from ebbtide.llm import registry
from ebbtide.llm.quality_rules import quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def brute(rows, line_docs, least=10):
    """(id, n_words, n_dup_lines, n_repeat_words, n_line_words, base_failed, kept) of (id, text, host) rows."""
    lines = [[x for x in (t or "").split("\n") if words(x)] for _, t, _ in rows]
    normal = [[re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(words(x))) for x in own] for own in lines]
    held = Counter((h, x) for (_, _, h), own in zip(rows, normal) for x in set(own))
    out = []
    for (i, text, host), own, plain in zip(rows, lines, normal):
        w = words(text)
        seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        repeat = {p for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        gone = sum(len(words(x)) for x in plain if held[host, x] > line_docs)
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        left = len(w) - gone
        out.append((i, len(w), len(own) - len(set(own)), len(repeat), gone, failed, not failed and left >= least and left >= 0.5 * len(w)))
    return out


def corpus():
    own = lambda i, n=12: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"Accept  ALL cookies to go on\n{own(i)}", "big") for i in range(300)]
    rows += [(1000 + i, own(i) + "y", "big") for i in range(700)]
    rows += [(3000 + i, f"accept all cookies to go on\n{own(i)}z", "small") for i in range(20)]
    rows += [(4000 + i, "the same menu of every page with many links and words here\nAccept all cookies to go on\nshort own", "big") for i in range(21)]
    rows += [(5000, f"accept all cookies to go on\nAccept all cookies to go on\n{own(5)}", "big"), (5001, None, "big"), (5002, "", None)]
    return rows


def test_a_line_goes_by_its_count_alone(spark, documents, tmp_path):
    """300 of 1,000 documents of a host hold a line, 20 of 20 of another one; documents of such lines alone are rejected."""
    rows = corpus()
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    query = registry.op7_quality_rules(spark, str(tmp_path))
    found = {r.doc_id: r for r in query.collect()}
    assert found[0].n_line_words == 6 and found[0].kept and found[3000].n_line_words == 0
    assert found[4000].n_line_words == 20 and not found[4000].base_failed and not found[4000].kept
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cursor = con.execute(registry.SQL["op7_quality_rules"])
    names = [c[0] for c in cursor.description]
    assert canonical(query.columns, [tuple(r) for r in found.values()]) == canonical(names, cursor.fetchall())


def test_all_columns_on_odd_rows(odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    for line_docs in (1, 20):
        found = quality_rules(odd, line_docs=line_docs).collect()
        got = [(r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.n_line_words, r.base_failed, r.kept) for r in found]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows, line_docs)))
