"""Request payloads: JSON coercion, validation, policy lookup, batch envelopes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.numeric import to_double

DEFAULT_THRESHOLD = 0.5

# Accepted names of each request field, first match wins.
REQUEST_ALIASES: dict[str, tuple[str, ...]] = {
    "customer_id": ("customer_id", "PID"),
    "total_subs": ("total_subs", "Total_SUBs"),
    "avg_mobile_revenue": ("avg_mobile_revenue", "AvgMobileRevenue"),
    "avg_fix_revenue": ("avg_fix_revenue", "AvgFIXRevenue"),
    "total_revenue": ("total_revenue", "TotalRevenue"),
    "arpu": ("arpu", "ARPU"),
    "active_subscribers": ("active_subscribers", "Active_subscribers"),
    "not_active_subscribers": ("not_active_subscribers", "Not_Active_subscribers"),
    "suspended_subscribers": ("suspended_subscribers", "Suspended_subscribers"),
    "crm_segment": ("crm_segment", "CRM_PID_Value_Segment"),
    "effective_segment": ("effective_segment", "EffectiveSegment"),
}
TEXT_DEFAULTS = {"customer_id": "", "crm_segment": "Unknown", "effective_segment": "Unknown"}


OBJECT = "map<string,string>"  # field names keep their case, values their text


def record_of(body: Column) -> Column:
    """The request of a JSON text: an object, or the first item of a list, else null."""
    text = F.trim(body)
    listed = F.try_element_at(F.from_json(text, f"array<{OBJECT}>"), F.lit(1))
    return F.when(text.startswith("["), listed).when(text.startswith("{"), F.from_json(text, OBJECT))


def with_request(bodies: DataFrame, body: str) -> DataFrame:
    """Typed request columns with defaults; ``raw_body`` keeps an unreadable text."""
    parsed = bodies.withColumn("_record", record_of(F.col(body)))

    def text(name: str) -> Column:
        return F.coalesce(*[F.try_element_at("_record", F.lit(a)) for a in REQUEST_ALIASES[name]])

    columns = {
        name: F.coalesce(text(name), F.lit(TEXT_DEFAULTS[name]))
        if name in TEXT_DEFAULTS
        else F.coalesce(to_double(text(name)), F.lit(0.0))
        for name in REQUEST_ALIASES
    }
    columns["history_arpu"] = F.from_json(F.try_element_at("_record", F.lit("history_arpu")), "array<double>")
    columns["raw_body"] = F.when(F.col("_record").isNull(), F.col(body))
    typed = parsed.withColumns(columns)
    per_line = F.when((F.col("arpu") == 0) & (F.col("total_subs") > 0), F.col("total_revenue") / F.col("total_subs"))
    return typed.withColumn("arpu", F.coalesce(per_line, F.col("arpu"))).drop("_record")


# Texts that stand for a missing value.
EMPTY_WORDS = ("", "None", "null")


def empty_to_null(text: Column) -> Column:
    return F.when(~text.isin(*EMPTY_WORDS), text)


def validation_errors(rules: Mapping[str, Column]) -> Column:
    """Names of the violated rules; a rule that is unknown (null input) holds."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()
    ]))


def split_valid(checked: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size(errors) == 0), checked.where(F.size(errors) > 0)


def usable_threshold(text: Column, default: float = DEFAULT_THRESHOLD) -> Column:
    value = to_double(text)
    return F.when(value.between(0.0, 1.0), value).otherwise(F.lit(default))


def policy_threshold(policy: Column, override: Column | None = None, default: float = DEFAULT_THRESHOLD) -> Column:
    """Decision threshold of a policy document.

    A non-empty override wins, then the first place that names a threshold:
    ``selected_threshold``, ``best.threshold``, ``best_validation.threshold``. Whatever
    wins but is no number in [0, 1] gives the default.
    """

    document = F.from_json(policy, OBJECT)

    def names(part: Column, key: str) -> Column:
        return F.coalesce(F.map_contains_key(part, key), F.lit(False))

    def value(part: Column, key: str) -> Column:
        return usable_threshold(F.try_element_at(part, F.lit(key)), default)

    def inner(name: str) -> Column:
        return F.from_json(F.try_element_at(document, F.lit(name)), OBJECT)

    given = F.coalesce(override != "", F.lit(False)) if override is not None else F.lit(False)
    return (
        F.when(given, usable_threshold(override if override is not None else F.lit(None), default))
        .when(names(document, "selected_threshold"), value(document, "selected_threshold"))
        .when(names(inner("best"), "threshold"), value(inner("best"), "threshold"))
        .when(names(inner("best_validation"), "threshold"), value(inner("best_validation"), "threshold"))
        .otherwise(F.lit(default))
    )


def open_envelope(batches: DataFrame, batch: str, items: str) -> DataFrame:
    """One row per request of each batch."""
    return batches.select(batch, F.inline(items))


def close_envelope(answers: DataFrame, batch: str, alert: str, order: str) -> DataFrame:
    """Answers back into one row per batch with counts; no larger than the request was."""
    fields = [c for c in answers.columns if c != batch]
    ordered = F.struct(F.col(order).alias("_order"), F.struct(*fields).alias("answer"))
    return answers.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col(alert)).alias("alert_required_count"),
        F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x["answer"]).alias("predictions"),
    )
