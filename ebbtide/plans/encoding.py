"""Plans for splits, samples, weights, encoders and scaling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import rounded
from ebbtide.operators import crm, encoders, sampling
from ebbtide.operators.category_stage import RareOneHot
from ebbtide.plans.accounts import PREPARED
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.session import pin
from ebbtide.sources.feeds import Feeds

SEED = "42"


def _ranked(source: str, row_id: str, strata: str = "", where: str = "") -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return (f"SELECT *, ROW_NUMBER() OVER ({part}ORDER BY MD5('{SEED}:' || CAST({row_id} AS VARCHAR)), {row_id}) AS r, "
            f"COUNT(*) OVER ({part.strip()}) AS n FROM {source}{where}")


_LABEL_RANK = {"k": _ranked("churn_labels", "entity_id", "is_churn")}
_SPLIT = ("CASE WHEN r <= FLOOR(n * 0.2e0 + 0.5) THEN 'test' "
          "WHEN r <= FLOOR(n * 0.2e0 + 0.5) + FLOOR((n - FLOOR(n * 0.2e0 + 0.5)) * 0.25e0 + 0.5) THEN 'val' ELSE 'train' END")


@query(statement("churn_labels", f"SELECT entity_id, is_churn, {_SPLIT} AS split FROM k", **_LABEL_RANK))
def stratified_split(feeds: Feeds) -> DataFrame:
    """60/20/20 per class, exact and reproducible."""
    return sampling.stratified_split(feeds.churn_labels(), "entity_id", "is_churn", SEED)


@query(statement("churn_labels", "SELECT entity_id, is_churn, CAST((r - 1) % 5 AS INT) AS fold FROM k", **_LABEL_RANK))
def stratified_folds(feeds: Feeds) -> DataFrame:
    """Five folds, even within each class."""
    return sampling.stratified_folds(feeds.churn_labels(), "entity_id", "is_churn", SEED, 5)


@query(statement("churn_labels", """SELECT entity_id, is_churn FROM k
WHERE (SELECT COUNT(*) FROM k) <= 600 OR r <= ROUND_EVEN(n * (600e0 / (SELECT COUNT(*) FROM k)), 0)""", **_LABEL_RANK))
def stratified_cap(feeds: Feeds) -> DataFrame:
    """A sample of about 600 labels that keeps the class shares."""
    return sampling.stratified_cap(feeds.churn_labels(), "entity_id", "is_churn", SEED, 600)


@query(statement("churn_labels", """SELECT entity_id, is_churn FROM k
WHERE is_churn = 0 OR r <= (SELECT COUNT(*) FROM k WHERE is_churn = 0)""", **_LABEL_RANK))
def balanced_sample(feeds: Feeds) -> DataFrame:
    """All rows of the smaller class and as many of the larger."""
    return sampling.balanced_sample(feeds.churn_labels(), "entity_id", "is_churn", SEED, minority=0)


_COPIES = """CASE WHEN is_churn = 0 THEN (many - few) // few + CASE WHEN r <= (many - few) % few THEN 1 ELSE 0 END ELSE 0 END"""
_SIZES = "SELECT COUNT(*) FILTER (is_churn = 0) AS few, COUNT(*) FILTER (is_churn = 1) AS many FROM churn_labels"


@query(statement("churn_labels", f"""SELECT entity_id, is_churn, g.copy FROM (SELECT k.*, {_COPIES} AS copies FROM k, z) k2,
  LATERAL (SELECT UNNEST(RANGE(0, copies + 1)) AS copy) g""", **_LABEL_RANK, z=_SIZES))
def oversample(feeds: Feeds) -> DataFrame:
    """Minority rows repeated until the classes are even."""
    return sampling.oversample(feeds.churn_labels(), "entity_id", "is_churn", SEED, minority=0)


@query(statement("members", """SELECT entity_id, city, bd FROM k WHERE r <= 100""",
                 k=_ranked("members", "entity_id", where=" WHERE bd IS NOT NULL AND city IS NOT NULL")))
def hash_sample(feeds: Feeds) -> DataFrame:
    """One hundred complete profiles in hash order."""
    people = feeds.members().select("entity_id", "city", "bd")
    return sampling.hash_sample(people, "entity_id", SEED, 100, complete=["city", "bd"])


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1
UNION SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def dedupe_first(feeds: Feeds) -> DataFrame:
    """First row per key in an explicit order, united with the first rows per finer key without repeats."""
    orders = feeds.table("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    order = ["o_orderdate", "o_orderkey"]
    first = sampling.keep_first(orders, ["o_custkey"], order)
    finer = sampling.keep_first(orders, ["o_custkey", "o_orderstatus"], order)
    return first.union(finer).drop("o_orderdate").distinct()


@query(statement("churn_labels members", """SELECT l.entity_id, l.is_churn, k.entity_id AS pool_id, k.city AS pool_city, k.bd AS pool_bd
FROM churn_labels l JOIN k ON k.r = CAST('0x' || SUBSTR(MD5('42:' || CAST(l.entity_id AS VARCHAR)), 1, 15) AS BIGINT)
  % (SELECT COUNT(*) FROM members) + 1""", k=_ranked("members", "entity_id")))
def pool_random_attach(feeds: Feeds) -> DataFrame:
    """Every label with one profile drawn at random."""
    pool = feeds.members().select(F.col("entity_id").alias("pool_id"), F.col("city").alias("pool_city"), F.col("bd").alias("pool_bd"))
    return sampling.attach_random(feeds.churn_labels(), "entity_id", pool, "pool_id", SEED)


@query(statement("churn_labels", """SELECT is_churn, COUNT(*) AS rows,
  ROUND((SELECT COUNT(*) FROM churn_labels) / ((SELECT COUNT(DISTINCT is_churn) FROM churn_labels) * COUNT(*)), 6) AS balanced_weight,
  ROUND(COUNT(*) / (SELECT COUNT(*) FROM churn_labels), 6) AS share,
  ROUND((SELECT COUNT(*) FROM churn_labels WHERE is_churn = 0)
    / GREATEST((SELECT COUNT(*) FROM churn_labels WHERE is_churn = 1), 1), 6) AS scale_pos_weight
FROM churn_labels GROUP BY is_churn"""))
def class_weights(feeds: Feeds) -> DataFrame:
    """Class sizes, balanced weights, class ratio."""
    return rounded(sampling.class_weights(feeds.churn_labels(), "is_churn"))


@query(statement("churn_labels transactions", """SELECT entity_id, is_churn, NULL AS paid, 1e0 AS weight FROM churn_labels
UNION ALL SELECT entity_id, is_cancel, ROUND(paid, 6), 0.3e0 FROM transactions"""))
def source_weights(feeds: Feeds) -> DataFrame:
    """Target rows at weight 1, auxiliary rows at 0.3."""
    target = feeds.churn_labels().withColumn("paid", F.lit(None).cast("double"))
    other = feeds.transactions().select("entity_id", F.col("is_cancel").alias("is_churn"), "paid")
    return rounded(sampling.with_source_weight(target, other, 0.3))


_SCALE = "(SELECT COUNT(*) FILTER (y = 0) / CAST(GREATEST(COUNT(*) FILTER (y = 1), 1) AS DOUBLE) FROM scores)"
_RAW = {
    "focal_positive": "CASE WHEN y = 1 THEN s * POW(1 - p, 2) ELSE POW(p, 2) END",
    "focal_balanced": "CASE WHEN y = 1 THEN s * POW(1 - p, 2) ELSE POW(p, 2) END * CASE WHEN p BETWEEN 0.35e0 AND 0.65e0 THEN 2 ELSE 1 END",
    "ambiguous_positive": "CASE WHEN y = 1 AND p < 0.25e0 THEN s * 3.5e0 WHEN y = 1 AND p <= 0.65e0 THEN s * 2.5e0 WHEN y = 1 THEN s ELSE 1 END",
}


@query(statement("scores", "SELECT row_id, y, " + ", ".join(
    f"ROUND({m} / AVG({m}) OVER (), 6) AS {m}" for m in _RAW) + " FROM w",
                 q=f"SELECT row_id, y, LEAST(GREATEST(s1, 1e-6), 1 - 1e-6) AS p, {_SCALE} AS s FROM scores",
                 w="SELECT row_id, y, " + ", ".join(
                     f"LEAST(GREATEST({e}, 0.05e0), s * 4) AS {m}" for m, e in _RAW.items()) + " FROM q"))
def focal_weights(feeds: Feeds) -> DataFrame:
    """Weights that stress hard rows, in three forms, each with mean 1."""
    rows = feeds.scores().select("row_id", "y", "s1")
    scale = rows.agg(F.count_if(F.col("y") == 0) / F.greatest(F.count_if(F.col("y") == 1), F.lit(1))).scalar()
    out = rows.withColumn("_scale", scale)
    for mode in _RAW:
        out = out.withColumn(mode, sampling.focal_weight(F.col("y"), F.col("s1"), F.col("_scale"), mode))
    means = out.agg(*[F.avg(m).alias(m) for m in _RAW])
    out = out.withColumn("_means", means.select(F.struct(*_RAW)).scalar())
    return rounded(out.select("row_id", "y", *[(F.col(m) / F.col(f"_means.{m}")).alias(m) for m in _RAW]))


# ---- encoders -----------------------------------------------------------------------

_ROWS = PREPARED + " WHERE LOWER(TRIM(\"CHURN\")) IN ('yes', 'no')"
_LINES = {
    "p": _ROWS,
    "x": """SELECT "PID" || '/' || eff AS row_id, ka, crm, eff, subs, arpu, zip, SUBSTR(zip_text, 1, 2) AS region,
  CASE WHEN LOWER(TRIM("CHURN")) = 'yes' THEN 1 ELSE 0 END AS y, CAST("PID" AS BIGINT) % 5 AS part,
  CASE WHEN CAST("PID" AS BIGINT) % 7 = 0 THEN NULL ELSE revenue END AS revenue FROM p""",
    "t": "SELECT * FROM x WHERE part <> 0",
}


def account_rows(feeds: Feeds) -> DataFrame:
    """Labelled account lines with a row id, a part number and a revenue column with gaps."""
    df = crm.prepared(feeds.crm_accounts())
    y = F.lower(F.trim("CHURN"))
    number = F.col("PID").cast("bigint")
    return df.where(y.isin("yes", "no")).select(
        F.concat_ws("/", "PID", "EffectiveSegment").alias("row_id"), F.col("KA_name").alias("ka"),
        F.col("CRM_PID_Value_Segment").alias("crm"), F.col("EffectiveSegment").alias("eff"),
        F.col("Total_SUBs").alias("subs"), F.col("ARPU").alias("arpu"), F.col("Billing_ZIP").alias("zip"),
        F.col("zip_prefix_2").alias("region"), (y == "yes").cast("int").alias("y"), (number % 5).alias("part"),
        F.when(number % 7 != 0, F.col("TotalRevenue")).alias("revenue"))


def _train(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("part") != 0)


@query(statement("crm_accounts", """SELECT x.row_id, x.zip, ROUND(COALESCE(f.n / (SELECT COUNT(*) FROM t), 0), 6) AS zip_freq
FROM x LEFT JOIN (SELECT zip, COUNT(*) AS n FROM t WHERE zip IS NOT NULL GROUP BY zip) f ON f.zip = x.zip""", **_LINES))
def frequency_encode(feeds: Feeds) -> DataFrame:
    """Relative frequency of a category in the training rows; unseen ones 0."""
    rows = account_rows(feeds).select("row_id", "zip", "part")
    return rounded(encoders.frequency_encode(rows, _train(rows), "zip", "zip_freq").select(
        "row_id", F.col("zip").cast("int").alias("zip"), "zip_freq"))


def _target_sql(column: str, m: int) -> str:
    rate = f"(SUM(y) + {m} * (SELECT AVG(y) FROM t)) / (COUNT(*) + {m})"
    clipped = f"LEAST(GREATEST({rate}, 1e-5), 1 - 1e-5)"
    return f"SELECT {column}, COUNT(*) AS n, {rate} AS rate, LN({clipped} / (1 - {clipped})) AS woe FROM t GROUP BY {column}"


@query(statement("crm_accounts", "SELECT ka, n AS ka_rows, ROUND(rate, 6) AS ka_rate, ROUND(woe, 6) AS ka_woe FROM e",
                 **_LINES, e=_target_sql("ka", 30)))
def smoothed_target_woe(feeds: Feeds) -> DataFrame:
    """Smoothed churn rate and its log-odds per account group."""
    return rounded(encoders.target_table(_train(account_rows(feeds)), "ka", "y", 30.0, "ka"))


@query(statement("crm_accounts", """SELECT x.row_id, x.zip, ROUND(COALESCE(rate, (SELECT AVG(y) FROM t)), 6) AS zip_rate,
  ROUND(COALESCE(woe, LN((SELECT AVG(y) FROM t) / (1 - (SELECT AVG(y) FROM t)))), 6) AS zip_woe
FROM x LEFT JOIN e ON e.zip = x.zip""", **_LINES, e=_target_sql("zip", 25)))
def target_apply(feeds: Feeds) -> DataFrame:
    """Fitted target encoding on all rows; unseen categories get the training mean."""
    rows = account_rows(feeds).select("row_id", "zip", "part", "y")
    return rounded(encoders.target_encode(rows, _train(rows), "zip", "y", 25.0, "zip").select(
        "row_id", F.col("zip").cast("int").alias("zip"), "zip_rate", "zip_woe"))


@query(statement("crm_accounts", """SELECT row_id, fold, ROUND(a, 6) AS ka_rate, ROUND(LN(LEAST(GREATEST(a, 1e-5), 1 - 1e-5)
    / (1 - LEAST(GREATEST(a, 1e-5), 1 - 1e-5))), 6) AS ka_woe, ROUND(b, 6) AS region_rate FROM (SELECT f.row_id, f.fold,
  (COALESCE(tk.s - ck.s, 0) + 25 * (SELECT AVG(y) FROM f)) / (COALESCE(tk.n - ck.n, 0) + 25) AS a,
  (COALESCE(tr.s - cr.s, 0) + 60 * pf.m) / (COALESCE(tr.n - cr.n, 0) + 60) AS b
FROM f JOIN ck ON ck.ka = f.ka AND ck.fold = f.fold JOIN (SELECT ka, SUM(s) AS s, SUM(n) AS n FROM ck GROUP BY ka) tk ON tk.ka = f.ka
JOIN cr ON cr.region = f.region AND cr.fold = f.fold
JOIN (SELECT region, SUM(s) AS s, SUM(n) AS n FROM cr GROUP BY region) tr ON tr.region = f.region
JOIN (SELECT q.fold, (SELECT AVG(y) FROM f g WHERE g.fold <> q.fold) AS m FROM (SELECT DISTINCT fold FROM f) q) pf ON pf.fold = f.fold)""",
                 **_LINES, k=_ranked("t", "row_id", "y"), f="SELECT *, CAST((r - 1) % 5 AS INT) AS fold FROM k",
                 ck="SELECT ka, fold, SUM(y) AS s, COUNT(*) AS n FROM f GROUP BY ka, fold",
                 cr="SELECT region, fold, SUM(y) AS s, COUNT(*) AS n FROM f GROUP BY region, fold"))
def oof_target(feeds: Feeds) -> DataFrame:
    """Out-of-fold target encodings with both kinds of prior."""
    rows = _train(account_rows(feeds)).select("row_id", "ka", "region", "y")
    # slim rows, read by both encodings and their joins
    folded = pin(sampling.stratified_folds(rows, "row_id", "y", SEED, 5))
    by_account = encoders.out_of_fold_table(folded, "ka", "y", "fold", 25.0, "ka")
    by_region = encoders.out_of_fold_table(folded, "region", "y", "fold", 60.0, "region", fold_prior=True)
    encoded = folded.join(by_account, ["ka", "fold"], "left").join(by_region, ["region", "fold"], "left")
    return rounded(encoded.select("row_id", "fold", "ka_rate", "ka_woe", "region_rate"))


@query(statement("crm_accounts", """SELECT row_id, COALESCE(c.code, -1) AS zip_code FROM x
LEFT JOIN (SELECT zip, ROW_NUMBER() OVER (ORDER BY zip) - 1 AS code FROM (SELECT DISTINCT zip FROM t WHERE zip IS NOT NULL)) c
  ON c.zip = x.zip""", **_LINES))
def ordinal_encode(feeds: Feeds) -> DataFrame:
    """Sorted training categories as integers, unseen ones -1."""
    rows = account_rows(feeds).select("row_id", "zip", "part")
    return encoders.ordinal_encode(rows, _train(rows), "zip", "zip_code").select("row_id", "zip_code")


@query(statement("crm_accounts", """SELECT row_id, COALESCE(c.code, (SELECT COUNT(*) FROM c)) AS zip_index, c.code IS NULL AS zip_index_rare,
  (SELECT COUNT(*) FROM c) + 1 AS hot_width, COALESCE(c.code, (SELECT COUNT(*) FROM c)) AS hot_at, CASE WHEN c.code = 0 THEN 1e0 ELSE 0e0 END AS hot_first,
  CASE WHEN c.code IS NULL THEN 1e0 ELSE 0e0 END AS hot_rare, 1e0 AS hot_sum FROM x LEFT JOIN c ON c.zip = x.zip""", **_LINES,
                 c="""SELECT zip, ROW_NUMBER() OVER (ORDER BY zip) - 1 AS code
FROM (SELECT zip FROM t WHERE zip IS NOT NULL GROUP BY zip HAVING COUNT(*) >= 5)"""))
def onehot_infrequent(feeds: Feeds) -> DataFrame:
    """One-hot index and columns with rare and unseen categories in one bucket."""
    rows = account_rows(feeds).select("row_id", "zip", "part")
    indexed = encoders.one_hot_index(rows, _train(rows), "zip", "zip_index")
    model = RareOneHot(inputCol="zip", outputCol="hot").fit(_train(rows))
    hot = vector_to_array("hot")
    wide = model.transform(indexed).withColumn("hot", hot)
    return wide.select(
        "row_id", "zip_index", "zip_index_rare", F.size("hot").cast("bigint").alias("hot_width"),
        (F.array_position("hot", F.lit(1.0)) - 1).alias("hot_at"), F.col("hot")[0].alias("hot_first"), F.element_at("hot", -1).alias("hot_rare"),
        F.aggregate("hot", F.lit(0.0), lambda a, x: a + x).alias("hot_sum"))


_NUMERIC = ("revenue", "subs", "arpu")


@query(statement("crm_accounts", "SELECT row_id, " + ", ".join(
    f"ROUND((COALESCE({c}, (SELECT MEDIAN({c}) FROM t)) - (SELECT AVG({c}) FROM i)) / (SELECT STDDEV_POP({c}) FROM i), 6) AS {c}"
    for c in _NUMERIC) + " FROM x", **_LINES, i="SELECT " + ", ".join(
        f"COALESCE({c}, (SELECT MEDIAN({c}) FROM t)) AS {c}" for c in _NUMERIC) + " FROM t"))
def impute_scale(feeds: Feeds) -> DataFrame:
    """Exact medians into gaps, then standard scaling with the population deviation."""
    rows = account_rows(feeds).select("row_id", "part", *_NUMERIC)
    return rounded(encoders.impute_and_scale(rows, _train(rows), _NUMERIC).select("row_id", *_NUMERIC))


@query(statement("crm_accounts", "SELECT row_id, " + ", ".join(
    f"ROUND(({c} - (SELECT MEDIAN({c}) FROM t)) / (SELECT CASE WHEN QUANTILE_CONT({c}, 0.75) = QUANTILE_CONT({c}, 0.25) THEN 1 "
    f"ELSE QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25) END FROM t), 6) AS {c}" for c in _NUMERIC) + " FROM x", **_LINES))
def robust_scale(feeds: Feeds) -> DataFrame:
    """Median and interquartile scaling."""
    rows = account_rows(feeds).select("row_id", "part", *_NUMERIC)
    return rounded(encoders.robust_scale(rows, _train(rows), _NUMERIC).select("row_id", *_NUMERIC))
