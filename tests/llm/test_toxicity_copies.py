"""Copies of a labelled text teach the toxicity field no more than the text once."""

from __future__ import annotations

import numpy as np


def test_copies_teach_once(spark):
    from ebbtide.llm.toxicity import fitted

    texts = [(f"plain words of number{i} and so on", 0) for i in range(40)] + [(f"vile filth of number{i} and so on", 1) for i in range(20)]
    copies = [(t, y) for t, y in texts for _ in range(300 if y == 1 and "number3 " in t or t.startswith("plain words of number7 ") else 1)]
    make = lambda rows: spark.createDataFrame(rows, "text string, toxic int")
    # the sample holds every distinct text, but not every row
    once, moves = fitted(make(texts), "text", "toxic", 60)
    many, moved = fitted(make(copies).repartition(5), "text", "toxic", 60)
    assert once.any() and np.array_equal(once, many) and np.array_equal(moves, moved)
