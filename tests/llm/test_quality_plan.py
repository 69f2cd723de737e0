"""The plan of the quality statistics makes the sorted windows of a text once, whatever the number of uses."""

from __future__ import annotations

from ebbtide.llm.quality_rules import statistics


def test_windows_are_sorted_once(documents):
    same = "a b c d e f g " * 3
    rows = documents([(1, same, "x"), (2, "a b  c\td\n e f", "x"), (3, None, "x"), (4, " \n ", "x"), (5, "one  two", "x")])
    found = statistics(rows.select("doc_id", "text"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(transform(") == 1
    assert found.columns == ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_repeat_words) for r in found.collect()}
    assert got == {1: (21, 21, 21), 2: (6, 6, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (2, 6, 0)}
