"""Alert decisions on a stream, remembering the last alert of each customer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ebbtide.functions import decisions as d

#: What the state tells about an event: its alert goes out, the case is resolved, or the repeat interval is not over.
DUE, CLOSED, REPEATED = 0, 1, 2
ANSWER = (
    "event_id bigint, customer_id bigint, event_time timestamp, churn_probability double, risk_level string, priority boolean, verdict int"
)
#: Last handled position, last sent alert (null before the first), last probability and rank, and the timer of the state.
STATE = StructType([
    StructField("position_us", LongType()), StructField("position_id", LongType()), StructField("alert_us", LongType()),
    StructField("probability", DoubleType()), StructField("rank", IntegerType()), StructField("timer_ms", LongType()),
])
HOUR_US = 3_600_000_000


def verdicts(
    time_us: np.ndarray, probability: np.ndarray, rank: np.ndarray, closed: np.ndarray, hours: np.ndarray, alert_us: int | None,
    before_probability: float | None, before_rank: int | None,
) -> tuple[np.ndarray, int | None]:
    """Verdicts of a customer's events in time order, and the last alert after them.

    Spikes and escalations follow from the event before, for all events at once; only events that are urgent and neither of the two depend
    on when the last alert went out.
    """
    urgent = rank >= d.RISK_RANKS["HIGH"]
    before_p = np.append(np.nan if before_probability is None else before_probability, probability[:-1])
    before_r = np.append(d.RISK_RANKS["CRITICAL"] if before_rank is None else before_rank, rank[:-1])
    forced = urgent & ((probability - before_p >= d.SPIKE) | (rank > before_r))
    out = np.full(len(rank), DUE, dtype=np.int32)
    for i in np.flatnonzero(urgent).tolist():
        if not forced[i] and alert_us is not None:
            if closed[i]:
                out[i] = CLOSED
                continue
            if time_us[i] - alert_us < hours[i] * HOUR_US:
                out[i] = REPEATED
                continue
        alert_us = int(time_us[i])
    return out, alert_us


class LastAlerts(StatefulProcessor):
    """One small value per customer, forgotten when the watermark is ``keep_hours`` past the customer's newest event."""

    def __init__(self, keep_hours: int) -> None:
        self.keep_ms = keep_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events of one customer in one micro-batch, in time order with the id as tie-break.

        An event at or before the last handled position is late: it is decided against the state as it is, and does not move it.
        """
        known = self.state.get() if self.state.exists() else None
        events = pd.concat(list(rows), ignore_index=True)
        events["time_us"] = events["event_time"].astype("datetime64[us]").astype("int64")
        events = events.sort_values(["time_us", "event_id"], ignore_index=True)
        position = (known[0], known[1]) if known else (-(2**62), -(2**62))
        late = ((events["time_us"] < position[0]) | ((events["time_us"] == position[0]) & (events["event_id"] <= position[1]))).to_numpy()
        alert_us, before_p, before_rank, timer = (known[2], known[3], known[4], known[5]) if known else (None, None, None, None)

        def judge(part: pd.DataFrame) -> tuple[np.ndarray, int | None]:
            columns = [part[c].to_numpy() for c in ("time_us", "churn_probability", "rank", "closed", "repeat_hours")]
            return verdicts(*columns, alert_us, before_p, before_rank)

        answers = np.zeros(len(events), dtype=np.int32)
        for i in np.flatnonzero(late):
            answers[i] = judge(events.iloc[i:i + 1])[0][0]
        new = events[~late]
        if len(new):
            answers[~late], alert_us = judge(new)
            newest = new.iloc[-1]
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = int(newest["time_us"]) // 1000 + self.keep_ms
            self.handle.registerTimer(timer)
            self.state.update((
                int(newest["time_us"]), int(newest["event_id"]), alert_us, float(newest["churn_probability"]), int(newest["rank"]), timer))
        names = ["event_id", "customer_id", "event_time", "churn_probability", "risk_level", "priority"]
        yield events.assign(customer_id=key[0], verdict=answers)[[*names, "verdict"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, delay: str = "3 days", keep_hours: int = 24 * 90) -> DataFrame:
    """Decisions for a stream of scored events: the alert policy with a small state per customer.

    Needs event_id, customer_id, event_time (timestamp), churn_probability, response_status, is_vip_customer,
    is_high_revenue_customer. Levels, resolved cases, intervals, channels and reasons are column expressions; the state
    gives the event before and the last alert. Events later than ``delay`` behind the newest one are dropped. A customer without
    events for ``keep_hours`` is forgotten and then starts anew. The session's state store must be the RocksDB one, as
    ``build_session`` sets it. A task holds the events of one customer in one micro-batch: the trigger bounds them.
    """
    level = d.risk_level("churn_probability")
    hours = F.when(level == "Critical", d.CRITICAL_REPEAT_HOURS).otherwise(d.HIGH_REPEAT_HOURS)
    priority = F.coalesce("is_vip_customer", F.lit(False)) | F.coalesce("is_high_revenue_customer", F.lit(False))
    inputs = events.withWatermark("event_time", delay).select(
        "event_id", "customer_id", "event_time", "churn_probability", level.alias("risk_level"), d.risk_rank(level).alias("rank"),
        d.resolved("response_status").alias("closed"), hours.alias("repeat_hours"), priority.alias("priority"))
    answers = inputs.groupBy("customer_id").transformWithStateInPandas(
        LastAlerts(keep_hours), ANSWER, outputMode="append", timeMode="eventTime")
    reason = d.suppress_reason(F.col("risk_level"), F.col("verdict") == CLOSED, F.col("verdict") == REPEATED)
    required = reason.isNull()
    channel = F.when(required, d.alert_channel(F.col("risk_level"), F.col("priority"))).otherwise("None")
    return answers.select(
        "event_id", "customer_id", "event_time", "churn_probability", "risk_level", required.alias("alert_required"),
        channel.alias("alert_channel"), reason.alias("suppress_reason"))
