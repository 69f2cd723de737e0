"""Plans over feature vectors: neighbour scores and synthetic rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import rounded
from ebbtide.operators import neighbours as nn
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.sources.feeds import Feeds

SEED = "7"
MINORITY = 0  # embedding label 0 against all others


def vectors(feeds: Feeds) -> DataFrame:
    return feeds.table("embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") != MINORITY).cast("int").alias("y"))


_V = {"v": f"SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, CASE WHEN label <> {MINORITY} THEN 1 ELSE 0 END AS y FROM embeddings"}


def _knn(queries: str, base: str, k: int, itself: bool) -> str:
    other = "WHERE a.vec_id <> b.vec_id" if itself else ""
    return (f"SELECT * FROM (SELECT a.vec_id AS id, b.vec_id AS neighbour, LIST_DISTANCE(a.vec, b.vec) AS distance, "
            f"ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY LIST_DISTANCE(a.vec, b.vec), b.vec_id) AS place "
            f"FROM {queries} a CROSS JOIN {base} b {other}) WHERE place <= {k}")


@query(statement("", "SELECT id, neighbour, ROUND(distance, 6) AS distance, CAST(place AS INT) AS place FROM n",
                 **_V, n=_knn("v", "v", 5, True)))
def nearest_rows(feeds: Feeds) -> DataFrame:
    """The five nearest rows of every row."""
    rows = vectors(feeds)
    return rounded(nn.nearest(rows, rows, 5, row_id="vec_id", vector="vec", itself=True))


@query(statement("", """SELECT n.id AS vec_id, ROUND(CASE WHEN COUNT(*) FILTER (distance = 0) > 0
    THEN AVG(t.y) FILTER (distance = 0) ELSE SUM(t.y / distance) / SUM(1 / distance) END, 6) AS score
FROM n JOIN t ON t.vec_id = n.neighbour GROUP BY n.id""", **_V, q="SELECT * FROM v WHERE vec_id % 5 = 0",
                 t="SELECT * FROM v WHERE vec_id % 5 <> 0", n=_knn("q", "t", 15, False)))
def knn_score(feeds: Feeds) -> DataFrame:
    """Distance-weighted vote of fifteen training neighbours for the held-out rows."""
    rows = vectors(feeds)
    held = F.col("vec_id") % 5 == 0
    return rounded(nn.knn_score(rows.where(held), rows.where(~held), "vec_id", "vec", "y", 1, 15))


@query(statement("", """SELECT id, majority_share, ROUND(COALESCE(majority_share / NULLIF(SUM(majority_share) OVER (), 0), 0), 6) AS weight,
  CAST(ROUND_EVEN(COALESCE(majority_share / NULLIF(SUM(majority_share) OVER (), 0), 0) * GREATEST((SELECT COUNT(*) FROM v WHERE y = 1)
    - (SELECT COUNT(*) FROM v WHERE y = 0), 0), 0) AS BIGINT) AS synthetic
FROM (SELECT n.id, COUNT(*) FILTER (v.y <> 0) / 5e0 AS majority_share FROM n JOIN v ON v.vec_id = n.neighbour GROUP BY n.id)""",
                 **_V, few="SELECT * FROM v WHERE y = 0", n=_knn("few", "v", 5, True)))
def adasyn_weights(feeds: Feeds) -> DataFrame:
    """How many synthetic rows each minority row should seed."""
    return rounded(nn.adasyn_plan(vectors(feeds), "vec_id", "vec", "y", 0))


@query(statement("", """SELECT a.id, a.neighbour, ROUND(a.distance, 6) AS distance, x.y AS label, z.y AS other_label
FROM n a JOIN n b ON b.id = a.neighbour AND b.neighbour = a.id JOIN v x ON x.vec_id = a.id JOIN v z ON z.vec_id = a.neighbour
WHERE a.id < a.neighbour AND x.y <> z.y""",
                 v="SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label % 2 AS y FROM embeddings", n=_knn("v", "v", 1, True)))
def tomek_links(feeds: Feeds) -> DataFrame:
    """Mutually nearest rows of different classes (odd against even labels)."""
    rows = feeds.table("embeddings").select("vec_id", F.col("embedding").alias("vec"), (F.col("label") % 2).alias("y"))
    return rounded(nn.tomek_links(rows, "vec_id", "vec", "y"))


def _hash_sql(seed: str) -> str:
    return f"CAST('0x' || SUBSTR(MD5('{seed}:' || id || ':' || copy), 1, 8) AS BIGINT)"


@query(statement("", f"""SELECT s.id, s.copy, n.neighbour, ROUND(s.alpha, 6) AS alpha, ROUND(a.vec[1] + s.alpha * (b.vec[1] - a.vec[1]), 6) AS first_value,
  ROUND(LIST_SUM(a.vec) + s.alpha * (LIST_SUM(b.vec) - LIST_SUM(a.vec)), 6) AS vector_sum
FROM (SELECT *, {_hash_sql(SEED + ':pick')} % 5 + 1 AS pick, {_hash_sql(SEED + ':alpha')} / 4294967296e0 AS alpha FROM sd) s
JOIN n ON n.id = s.id AND n.place = s.pick JOIN few a ON a.vec_id = s.id JOIN few b ON b.vec_id = n.neighbour""",
                 **_V, few="SELECT * FROM v WHERE y = 0", n=_knn("few", "few", 5, True),
                 rk=f"""SELECT vec_id AS id, ROW_NUMBER() OVER (ORDER BY MD5('{SEED}:' || vec_id), vec_id) AS r, COUNT(*) OVER () AS m,
  (SELECT COUNT(*) FROM v WHERE y = 1) - (SELECT COUNT(*) FROM v WHERE y = 0) AS extra FROM few""",
                 sd="""SELECT id, g.copy FROM rk,
  LATERAL (SELECT UNNEST(RANGE(1, extra // m + CASE WHEN r <= extra % m THEN 1 ELSE 0 END + 1)) AS copy) g"""))
def smote(feeds: Feeds) -> DataFrame:
    """Synthetic minority rows on the way to a nearest minority row."""
    made = nn.smote(vectors(feeds), "vec_id", "vec", "y", 0, SEED)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(made.select("id", "copy", "neighbour", "alpha", F.col("vec")[0].alias("first_value"), total.alias("vector_sum")))


# ---- numbers and categories ---------------------------------------------------------

_MIXED = """SELECT c_custkey AS id, [c_acctbal / 1000e0, CAST(COUNT(*) AS DOUBLE), MAX(o_totalprice) / 100000e0] AS vec, c_mktsegment AS segment,
  n_name AS city, ANY_VALUE(is_churn) AS y FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN churn_labels l ON l.entity_id = c_custkey GROUP BY c_custkey, c_acctbal, c_mktsegment, n_name"""


def mixed_rows(feeds: Feeds) -> DataFrame:
    """Customers with three numbers, two categories and the churn label."""
    orders = feeds.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("o_totalprice").alias("_most"))
    places = feeds.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    labels = feeds.churn_labels().select(F.col("entity_id").alias("id"), F.col("is_churn").alias("y"))
    vec = F.array(F.col("c_acctbal") / 1000.0, F.col("_n").cast("double"), F.col("_most") / 100000.0)
    return feeds.table("customer").withColumnRenamed("c_custkey", "id").join(orders, "id").join(places, "c_nationkey").join(labels, "id").select(
        "id", vec.alias("vec"), F.col("c_mktsegment").alias("segment"), "city", "y")


_SYNTHETIC = """SELECT s.id, s.copy, n.neighbour, ROUND(s.alpha, 6) AS alpha, ROUND(a.vec[1] + s.alpha * (b.vec[1] - a.vec[1]), 6) AS first_value,
  ROUND(LIST_SUM(a.vec) + s.alpha * (LIST_SUM(b.vec) - LIST_SUM(a.vec)), 6) AS vector_sum{more}
FROM (SELECT *, {pick} % 5 + 1 AS pick, {alpha} / 4294967296e0 AS alpha FROM sd) s
JOIN n ON n.id = s.id AND n.place = s.pick JOIN few a ON a.{key} = s.id JOIN few b ON b.{key} = n.neighbour{joins}"""


def _synthetic(key: str, more: str = "", joins: str = "") -> str:
    return _SYNTHETIC.format(key=key, more=more, joins=joins, pick=_hash_sql(SEED + ":pick"), alpha=_hash_sql(SEED + ":alpha"))


_APART = ("SQRT(POW(LIST_DISTANCE(a.vec, b.vec), 2) + 0.5e0 * d * d * (CAST(a.segment <> b.segment AS INT) + CAST(a.city <> b.city AS INT)))")


def _mode(c: str) -> str:
    return (f"SELECT id, {c} FROM (SELECT n.id, f.{c}, ROW_NUMBER() OVER (PARTITION BY n.id ORDER BY COUNT(*) DESC, f.{c}) AS rn "
            f"FROM n JOIN few f ON f.id = n.neighbour GROUP BY n.id, f.{c}) WHERE rn = 1")


@query(statement("churn_labels", _synthetic("id", ", g.segment, c.city", " JOIN ms g ON g.id = s.id JOIN mc c ON c.id = s.id"),
                 mx=_MIXED, few="SELECT * FROM mx WHERE y = 0",
                 dv="SELECT MEDIAN(s) AS d FROM (" + " UNION ALL ".join(f"SELECT STDDEV_POP(vec[{i}]) AS s FROM few" for i in (1, 2, 3)) + ")",
                 n=f"""SELECT * FROM (SELECT a.id, b.id AS neighbour, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY {_APART}, b.id) AS place
  FROM few a CROSS JOIN few b CROSS JOIN dv WHERE a.id <> b.id) WHERE place <= 5""",
                 rk=f"""SELECT id, ROW_NUMBER() OVER (ORDER BY MD5('{SEED}:' || id), id) AS r, COUNT(*) OVER () AS m,
  (SELECT COUNT(*) FROM mx WHERE y = 1) - (SELECT COUNT(*) FROM mx WHERE y = 0) AS extra FROM few""",
                 sd="""SELECT id, g.copy FROM rk,
  LATERAL (SELECT UNNEST(RANGE(1, extra // m + CASE WHEN r <= extra % m THEN 1 ELSE 0 END + 1)) AS copy) g""",
                 ms=_mode("segment"), mc=_mode("city")))
def smotenc(feeds: Feeds) -> DataFrame:
    """Synthetic customers of the smaller class between neighbours by numbers and categories."""
    made = nn.smotenc(mixed_rows(feeds), "id", "vec", ["segment", "city"], "y", 0, SEED)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(made.select(
        "id", "copy", "neighbour", "alpha", F.col("vec")[0].alias("first_value"), total.alias("vector_sum"), "segment", "city"))


@query(statement("", _synthetic("vec_id"), **_V, few="SELECT * FROM v WHERE y = 0", around=_knn("few", "v", 5, True),
                 hit="SELECT o.id, COUNT(*) FILTER (v.y <> 0) AS hits FROM around o JOIN v ON v.vec_id = o.neighbour GROUP BY o.id",
                 gap="SELECT GREATEST((SELECT COUNT(*) FROM v WHERE y <> 0) - (SELECT COUNT(*) FROM v WHERE y = 0), 0) AS wanted, SUM(hits) AS total FROM hit",
                 al=f"""SELECT id, CAST(hits * wanted // total AS BIGINT) AS each, wanted, ROW_NUMBER() OVER (
    ORDER BY hits * wanted % total DESC, hits DESC, MD5('{SEED}:' || id), id) AS turn FROM hit, gap WHERE total > 0""",
                 cp="SELECT id, each + CASE WHEN turn <= wanted - (SELECT SUM(each) FROM al) THEN 1 ELSE 0 END AS copies FROM al",
                 n=_knn("few", "few", 5, True),
                 sd="SELECT id, g.copy FROM cp, LATERAL (SELECT UNNEST(RANGE(1, copies + 1)) AS copy) g"))
def adasyn(feeds: Feeds) -> DataFrame:
    """Synthetic rows of the smaller class, more where its rows have neighbours of other classes."""
    made = nn.adasyn(vectors(feeds), "vec_id", "vec", "y", 0, SEED)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rounded(made.select("id", "copy", "neighbour", "alpha", F.col("vec")[0].alias("first_value"), total.alias("vector_sum")))
