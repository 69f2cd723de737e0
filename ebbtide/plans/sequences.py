"""Plans over entity time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import rounded
from ebbtide.operators import sequences as sq
from ebbtide.operators.windows_agg import plays
from ebbtide.plans.activity import PLAYS_SQL
from ebbtide.plans.catalog import query
from ebbtide.plans.statements import statement
from ebbtide.sources.feeds import Feeds

SHORT = 5  # sequence length of the checked plans: some entities are cut, some padded

_MOMENTUM = """SELECT *, COALESCE(m, 0) AS momentum,
  COALESCE(m - LAG(m) OVER (PARTITION BY entity_id ORDER BY day), 0) AS acceleration
FROM (SELECT *, energy / (LAG(energy) OVER (PARTITION BY entity_id ORDER BY day) + 1e-5) AS m FROM {source})"""

_BEHAVIOUR = f"""SELECT entity_id, log_date AS day, total_secs AS energy,
  LEAST(GREATEST(num_25 / (num_unq + 1e-5), 0), 1) AS skip_rate,
  LEAST(GREATEST(num_100 / (num_unq + 1e-5), 0), 1) AS completion_rate,
  LEAST(GREATEST(num_unq / ({PLAYS_SQL} + 1e-5), 0), 1) AS diversity_score
FROM usage_logs"""

_SERIES_STEPS = {"b": _BEHAVIOUR, "s": _MOMENTUM.format(source="b")}


def usage_series(feeds: Feeds) -> DataFrame:
    logs = sq.behaviour_channels(feeds.usage_logs(), plays())
    return sq.with_momentum(logs, "entity_id", "log_date", "energy")


@query(statement("usage_logs", """SELECT entity_id, day AS log_date, ROUND(energy, 6) AS energy,
  ROUND(momentum, 6) AS momentum, ROUND(acceleration, 6) AS acceleration, ROUND(skip_rate, 6) AS skip_rate,
  ROUND(completion_rate, 6) AS completion_rate, ROUND(diversity_score, 6) AS diversity_score FROM s""", **_SERIES_STEPS))
def energy_momentum(feeds: Feeds) -> DataFrame:
    """Momentum and acceleration of daily usage; the first two rows of an entity accelerate by 0."""
    return rounded(usage_series(feeds))


@query(statement("transactions", """SELECT entity_id, day AS txn_date, ROUND(energy, 4) AS energy,
  ROUND(momentum, 6) AS momentum, ROUND(acceleration, 6) AS acceleration FROM s""",
                 d="SELECT entity_id, txn_date AS day, SUM(paid) AS energy FROM transactions GROUP BY entity_id, txn_date",
                 s=_MOMENTUM.format(source="d")))
def daily_energy(feeds: Feeds) -> DataFrame:
    """Several purchases of a day summed first, then momentum."""
    daily = feeds.transactions().groupBy("entity_id", "txn_date").agg(F.sum("paid").alias("energy"))
    return rounded(sq.with_momentum(daily, "entity_id", "txn_date", "energy"), money={"energy": 4})


_SEQ_STEPS = _SERIES_STEPS | {
    "k": f"""SELECT *, LEAST(n, {SHORT}) - rn AS at FROM (SELECT *,
  ROW_NUMBER() OVER (PARTITION BY entity_id ORDER BY day DESC) AS rn,
  COUNT(*) OVER (PARTITION BY entity_id) AS n FROM s) WHERE rn <= {SHORT}""",
    "e": "SELECT entity_id, MAX(n) AS n FROM k GROUP BY entity_id",
    "p": f"""SELECT e.entity_id, g.step, LEAST(e.n, {SHORT}) AS length, COALESCE(l.is_churn, 0) AS is_churn,
  COALESCE(k.energy, 0) AS energy, COALESCE(k.momentum, 0) AS momentum, COALESCE(k.acceleration, 0) AS acceleration,
  COALESCE(k.skip_rate, 0) AS skip_rate, COALESCE(k.completion_rate, 0) AS completion_rate,
  COALESCE(k.diversity_score, 0) AS diversity_score
FROM e CROSS JOIN generate_series(0, {SHORT - 1}) g(step)
LEFT JOIN k ON k.entity_id = e.entity_id AND k.at = g.step
LEFT JOIN churn_labels l ON l.entity_id = e.entity_id""",
}


def _long(table: DataFrame, *carry: str) -> DataFrame:
    """One row per step with a column per channel."""
    steps = table.select("entity_id", *carry, F.posexplode("sequence").alias("step", "v"))
    return steps.select(
        "entity_id", F.col("step").cast("bigint").alias("step"), *carry,
        *[F.col("v")[i].alias(c) for i, c in enumerate(sq.CHANNELS)],
    )


@query(statement("usage_logs churn_labels", "SELECT entity_id, step, CAST(length AS INT) AS length, is_churn, "
                 + ", ".join(f"ROUND({c}, 6) AS {c}" for c in sq.CHANNELS) + " FROM p", **_SEQ_STEPS))
def sequence_pad(feeds: Feeds) -> DataFrame:
    """Newest steps per entity, zero rows behind short ones, shown one step per row."""
    table = sq.sequence_table(usage_series(feeds), feeds.churn_labels(), "entity_id", "log_date", SHORT)
    return rounded(_long(table, "length", "is_churn"))


@query(statement("usage_logs churn_labels", "SELECT entity_id, step, " + ", ".join(
    f"ROUND(({c} - (SELECT AVG({c}) FROM p WHERE entity_id % 5 <> 0)) / "
    f"(SELECT CASE WHEN STDDEV_POP({c}) = 0 THEN 1 ELSE STDDEV_POP({c}) END FROM p WHERE entity_id % 5 <> 0), 6) AS {c}"
    for c in sq.CHANNELS) + " FROM p", **_SEQ_STEPS))
def sequence_scale(feeds: Feeds) -> DataFrame:
    """Channels standardised with the statistics of the training entities only."""
    table = sq.sequence_table(usage_series(feeds), feeds.churn_labels(), "entity_id", "log_date", SHORT)
    fitted_on = table.where(F.col("entity_id") % 5 != 0)
    return rounded(_long(sq.scale_sequences(table, fitted_on, len(sq.CHANNELS))))


@query(statement("transactions", """
SELECT entity_id, pos, ROUND(energy, 4) AS energy, ROUND(momentum, 6) AS momentum,
  ROUND(CASE WHEN pos = 0 THEN 0 ELSE momentum - LAG(momentum) OVER (PARTITION BY entity_id ORDER BY pos) END, 6)
    AS acceleration, dropped
FROM (SELECT *, energy / CASE WHEN AVG(energy) OVER (PARTITION BY entity_id) = 0 THEN 1
                              ELSE AVG(energy) OVER (PARTITION BY entity_id) END AS momentum FROM x)""",
                 h="""SELECT entity_id, LIST(paid ORDER BY txn_date, txn_id) AS full_list, COUNT(*) AS n,
  SUM(paid) / COUNT(*) AS arpu, COUNT(*) FILTER (is_cancel = 0) AS active FROM transactions GROUP BY entity_id""",
                 r="""SELECT *, CASE WHEN entity_id % 10 = 0 THEN [] ELSE
  full_list[GREATEST(n - 29, 1):n] END AS hist FROM h""",
                 x="""SELECT entity_id, g.pos, CASE WHEN LEN(hist) > 0
    THEN hist[GREATEST(LEN(hist) - 30 + g.pos, 0) + 1]
    ELSE arpu / POW(CASE WHEN active / CAST(n AS DOUBLE) > 0.8 THEN 1e0 ELSE 0.95e0 END, 29 - g.pos) END AS energy,
  LEN(hist) >= 2 AND COALESCE(hist[1] > 0 AND hist[LEN(hist)] / hist[1] <= 0.4, FALSE) AS dropped
FROM r CROSS JOIN generate_series(0, 29) g(pos)"""))
def history_channels(feeds: Feeds) -> DataFrame:
    """Thirty steps per customer from its payments, or modelled where no history is given."""
    billing = feeds.transactions()
    recent = sq.last_steps(billing, "entity_id", ["txn_date", "txn_id"], ["paid"], sq.STEPS)
    totals = billing.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("paid") / F.count(F.lit(1))).alias("arpu"),
        F.count_if(F.col("is_cancel") == 0).alias("active"),
    )
    given = F.when(F.col("entity_id") % 10 != 0, F.transform("sequence", lambda v: v[0])).otherwise(
        F.array().cast("array<double>"))
    base = totals.join(recent, "entity_id").withColumn("given", given)
    shaped = base.select(
        "entity_id", sq.dropped_sharply(F.col("given")).alias("dropped"),
        sq.history_energy(F.col("given"), F.col("arpu"), F.col("active"), F.col("n")).alias("energy"),
    ).withColumn("momentum", sq.history_momentum(F.col("energy")))
    shaped = shaped.withColumn("acceleration", sq.first_difference(F.col("momentum")))
    points = shaped.select("entity_id", "dropped", F.posexplode(F.arrays_zip("energy", "momentum", "acceleration")).alias("pos", "v"))
    return rounded(points.select("entity_id", F.col("pos").cast("bigint").alias("pos"), "v.energy", "v.momentum",
                                 "v.acceleration", "dropped"), money={"energy": 4})
