"""Decision rules as column expressions: risk levels, alerts, retention value, routing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.functions.numeric import col

# Probability limits of the risk levels.
CRITICAL_FROM = 0.8
HIGH_FROM = 0.65
MEDIUM_FROM = 0.5

# Alert policy.
SPIKE = 0.20
CRITICAL_REPEAT_HOURS = 24
HIGH_REPEAT_HOURS = 72

# Other spellings of the risk levels (after trimming, upper case, _ as blank).
RISK_WORDS = {
    "CRITICAL": ("CRITICAL", "URGENT"),
    "HIGH": ("HIGH", "HIGH RISK"),
    "MEDIUM": ("MEDIUM", "MID", "MEDIUM RISK"),
}
RISK_RANKS = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}

# Response words that close a case.
RESOLVED_WORDS = (
    "done", "closed", "complete", "completed", "resolved", "responded", "response_complete",
    "대응완료", "완료", "해결",
)

# Reasons shown for a suppressed alert.
REASON_LOW = "Low 등급 고객은 알림 대상이 아니므로 로그만 저장함"
REASON_MEDIUM = "Medium 등급 고객은 실시간 알림 없이 Google Sheets에만 기록함"
REASON_RESOLVED = "담당자 대응이 완료된 고객으로 중복 알림을 차단함"
REASON_CRITICAL = "Critical 등급 고객은 최근 24시간 내 알림이 발송되어 재알림을 차단함"
REASON_HIGH = "High 등급 고객은 최근 3일 내 알림이 발송되어 중복 알림을 차단함"


def risk_level(probability: Column | str) -> Column:
    p = col(probability)
    return (F.when(p >= CRITICAL_FROM, "Critical").when(p >= HIGH_FROM, "High")
            .when(p >= MEDIUM_FROM, "Medium").otherwise("Low"))


def normal_risk(level: Column | str) -> Column:
    """Any spelling of a level to one of four words; unknown or missing is LOW."""
    word = F.upper(F.replace(F.trim(col(level)), F.lit("_"), F.lit(" ")))
    out = F.when(F.lit(False), "LOW")
    for name, words in RISK_WORDS.items():
        out = out.when(word.isin(*words), name)
    return out.otherwise("LOW")


def risk_rank(level: Column | str) -> Column:
    normal = normal_risk(level)
    out = F.when(normal == "CRITICAL", RISK_RANKS["CRITICAL"])
    for name in ("HIGH", "MEDIUM"):
        out = out.when(normal == name, RISK_RANKS[name])
    return out.otherwise(RISK_RANKS["LOW"])


def resolved(status: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(status))).isin(*RESOLVED_WORDS), F.lit(False))


def alert_micros(text: Column | str) -> Column:
    """Alert time text to microseconds since 1970 UTC.

    ``Z``, an offset, or no zone at all (then UTC); unreadable text gives null. The number
    does not depend on the session time zone.
    """
    t = F.trim(col(text))
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    parts = F.regexp_replace(t, r"(Z|[+-]\d{2}:?\d{2})$", "")
    return wall_micros(parts.try_cast("timestamp_ntz")) - F.when(zoned, offset_micros(t)).otherwise(F.lit(0))


def wall_micros(wall: Column) -> Column:
    """Microseconds between 1970-01-01 and a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), wall)


def offset_micros(text: Column) -> Column:
    found = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})$", 0)
    minutes = (F.substring(found, 2, 2).try_cast("bigint") * 60 + F.substring(found, -2, 2).try_cast("bigint"))
    signed = F.when(found.startswith("-"), -minutes).otherwise(minutes)
    return F.when(found == "", F.lit(0)).otherwise(signed) * 60_000_000


def spiked(probability: Column, previous: Column) -> Column:
    return F.coalesce(probability - previous >= SPIKE, F.lit(False))


def escalated(level: Column, previous: Column) -> Column:
    """Risk rank rose to High or Critical; without an earlier level it did not."""
    known = F.coalesce(previous != "", F.lit(False))
    return known & (risk_rank(level) > risk_rank(previous)) & (risk_rank(level) >= RISK_RANKS["HIGH"])


def alert_channel(level: Column, priority: Column) -> Column:
    urgent = normal_risk(level).isin("CRITICAL", "HIGH")
    return F.when(urgent & priority, "Slack,Gmail").when(urgent, "Slack").otherwise("None")


def suppress_reason(level: Column, closed: Column, repeated: Column) -> Column:
    """Why an event stays quiet, null when it alerts: its level, a resolved case, or an alert not long ago."""
    normal = normal_risk(level)
    return (
        F.when(normal == "LOW", REASON_LOW)
        .when(normal == "MEDIUM", REASON_MEDIUM)
        .when(closed, REASON_RESOLVED)
        .when(repeated & (normal == "CRITICAL"), REASON_CRITICAL)
        .when(repeated, REASON_HIGH)
    )


def alert_decision(
    level: Column, probability: Column, last_alert: Column, now: Column, status: Column,
    previous_probability: Column, previous_level: Column, vip: Column, high_revenue: Column,
) -> Column:
    """The alert policy as one ordered rule: struct of required, channel, reason, log.

    ``last_alert`` and ``now`` are microseconds. Order: Low and Medium never alert; a
    probability spike or an escalation always does; a resolved case with an earlier alert
    stays quiet; otherwise the repeat interval of the level decides.
    """
    normal = normal_risk(level)
    hours = F.when(normal == "CRITICAL", CRITICAL_REPEAT_HOURS).otherwise(HIGH_REPEAT_HOURS)
    due = last_alert.isNull() | F.coalesce(now - last_alert >= hours * 3_600_000_000, F.lit(False))
    forced = spiked(probability, previous_probability) | escalated(level, previous_level)
    closed = resolved(status) & last_alert.isNotNull()
    reason = suppress_reason(level, ~forced & closed, ~forced & ~closed & ~due)
    required = reason.isNull()
    priority = F.coalesce(vip, F.lit(False)) | F.coalesce(high_revenue, F.lit(False))
    return F.struct(
        required.alias("alert_required"),
        F.when(required, alert_channel(level, priority)).otherwise("None").alias("alert_channel"),
        reason.alias("suppress_reason"),
        F.lit(True).alias("log_required"),
    )


def ensemble_probability(table: Column, sequence: Column, trend: Column, history: Column) -> Column:
    """Blend of three model scores; weights depend on what is available.

    ``sequence`` may be null (model absent); a history of at least seven values counts as real.
    """
    real = F.coalesce(F.size(history), F.lit(0)) >= 7
    present = sequence.isNotNull()
    return (
        F.when(present & real, table * 0.3 + sequence * 0.3 + trend * 0.4)
        .when(present, table * 0.7 + sequence * 0.2 + trend * 0.1)
        .when(real, table * 0.4 + trend * 0.6)
        .otherwise(table * 0.8 + trend * 0.2)
    )


def expected_loss(predicted: Column, arpu: Column) -> Column:
    return F.when(predicted, arpu).otherwise(F.lit(0.0))


def retention_success(given: Column, sent: Column, churned: Column, status: Column) -> Column:
    """An explicit outcome wins; else alerted, still a customer, and the case closed."""
    inferred = F.coalesce(sent & ~churned & resolved(status), F.lit(False))
    return F.coalesce(given, inferred)


def retention_value(loss: Column, success: Column, action: Column, *others: Column) -> dict[str, Column]:
    """Cost, saved revenue, net benefit and return (null without cost)."""
    parts = [F.coalesce(c, F.lit(0.0)) for c in others]
    cost = F.coalesce(action, sum(parts[1:], parts[0]))
    saved = F.when(success, loss).otherwise(F.lit(0.0))
    net = saved - cost
    return {"retention_cost": cost, "saved_revenue": saved, "net_benefit": net, "roi": F.try_divide(net, cost)}


# Retention offers (probability reduction, cost); floor of an offer's result.
OFFERS = {
    "10% discount": (0.12, 30000),
    "direct account call": (0.09, 10000),
    "bundle retention offer": (0.16, 45000),
}
OFFER_FLOOR = 0.01


def offer_scenarios(probability: Column, offers: Mapping[str, tuple[float, float]] = OFFERS) -> Column:
    """Array of (expected_probability, position, action, action_cost), one per offer."""
    return F.array(*[
        F.struct(F.greatest(F.lit(OFFER_FLOOR), probability - less).alias("expected_probability"), F.lit(i).alias("position"),
                 F.lit(name).alias("action"), F.lit(float(cost)).alias("action_cost"))
        for i, (name, (less, cost)) in enumerate(offers.items())
    ])


def best_offer(scenarios: Column) -> Column:
    """Lowest expected probability, the earlier offer on a tie."""
    return F.array_min(scenarios)


# Limits of the approval rule and the channels of a notification.
APPROVAL_PROBABILITY = 0.7
APPROVAL_LOSS = 100000
URGENT_CHANNEL = "#churn-alert-high"
NORMAL_CHANNEL = "#churn-alert"


def needs_approval(probability: Column, loss: Column) -> Column:
    return (probability >= APPROVAL_PROBABILITY) | (loss >= APPROVAL_LOSS)


def chat_channel(level: Column) -> Column:
    return F.when(level == "Critical", URGENT_CHANNEL).otherwise(NORMAL_CHANNEL)


def percent_text(probability: Column) -> Column:
    return F.format_string("%.1f%%", probability * 100)
