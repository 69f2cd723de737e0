"""Rows whose group is null are a group of their own in the ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.functions import ordering as o
from ebbtide.operators.ranking import precision_recall, roc_auc


def rows_of(spark):
    """The same twelve values in the group without a key and in group 1."""
    rows = [(g, i, (i * 7) % 12, int(i % 3 == 0)) for g in (None, 1) for i in range(12)]
    return spark.createDataFrame(rows, "g long, id long, value long, label int")


def both(found, *columns):
    """The rows of the null group and of group 1."""
    rows = found.collect()
    return [sorted((tuple(r[c] for c in columns) for r in rows if r.g == g), key=lambda x: x[0]) for g in (None, 1)]


def test_running_totals(spark):
    counts = rows_of(spark).groupBy("g", "value").agg(F.count(F.lit(1)).alias("n"))
    null, one = both(o.running_totals(counts, "value", {"upto": "n"}, by=["g"], overall={"all": "n"}), "value", "upto", "all")
    assert null == one == [(v, v + 1, 12) for v in range(12)]


def test_exact_quantiles(spark):
    null, one = both(o.exact_quantiles(rows_of(spark), "value", {"m": 0.5}, by=["g"]), "m")
    assert null == one == [(5.5,)]


def test_ranking_metrics(spark):
    rows = rows_of(spark)
    null, one = both(roc_auc(rows, "label", "value", by=["g"]), "roc_auc")
    pos, neg = [(i * 7) % 12 for i in range(0, 12, 3)], [(i * 7) % 12 for i in range(12) if i % 3]
    assert null == one == [(sum(p > n for p in pos for n in neg) / 32,)]
    null, one = both(precision_recall(rows, "label", "value", by=["g"]), "threshold", "tp", "fp", "fn")
    assert null == one and len(null) == 12


def test_latest_before(spark):
    value = F.when(F.col("id") == 1, F.col("value"))
    null, one = both(o.latest_before(rows_of(spark), ["g"], ["id"], F.floor(F.col("id") / 4), value, "seen"), "id", "seen")
    assert null == one == [(i, 7 if i > 1 else None) for i in range(12)]
