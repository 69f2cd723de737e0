"""Leakage-safe account features as an estimator: fit on training rows, apply to any."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.base import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions.numeric import logit, sanitised
from ebbtide.functions.ordering import sorted_codes
from ebbtide.operators import crm, encoders
from ebbtide.operators.sampling import stratified_folds
from ebbtide.session import pin

MODES = ("core", "engineered", "encoded", "encoded_without_account", "encoded_compact")
BASE = ("Active_subscribers", "Not_Active_subscribers", "Suspended_subscribers", "Total_SUBs", "AvgMobileRevenue", "AvgFIXRevenue",
        "TotalRevenue", "ARPU", "Billing_ZIP", "not_active_missing", "suspended_missing", "arpu_missing", "billing_zip_missing")
CORE_RATIOS = ("active_ratio", "inactive_ratio", "mobile_revenue_ratio", "fixed_revenue_ratio")


def categories_of(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise ValueError(f"unknown feature mode {mode!r}")
    return crm.CATEGORY_MODES.get(mode, crm.CATEGORIES)


class AccountFeatures(Estimator):
    """Numeric features, category codes and frequencies, and target encodings by mode.

    ``pid_scope`` takes account statistics from the training rows or from a whole snapshot
    given as ``snapshot`` (they never use the target).
    """

    def __init__(self, row_id: str, label: str, mode: str = "encoded", smoothing: float = 25.0, folds: int = 5,
                 snapshot: DataFrame | None = None, with_pid: bool = False) -> None:
        super().__init__()
        categories_of(mode)
        self.row_id, self.label, self.mode = row_id, label, mode
        self.smoothing, self.folds = smoothing, folds
        self.snapshot, self.with_pid = snapshot, with_pid

    def _fit(self, dataset: DataFrame) -> "FittedAccountFeatures":
        train = crm.prepared(dataset)
        tables: dict[str, DataFrame] = {}
        if self.mode != "core":
            slim = pin(train.select(self.label, *categories_of(self.mode)))
            for c in categories_of(self.mode):
                parts = [sorted_codes(slim, c, f"{c}_ord"), encoders.frequency_table(slim, c, f"{c}_freq")]
                if self.mode.startswith("encoded"):
                    parts.append(encoders.target_table(slim, c, self.label, self.smoothing, c).drop(f"{c}_rows"))
                tables[c] = reduce(lambda a, b: a.join(b, c), parts)
        if self.with_pid:
            source = crm.prepared(self.snapshot) if self.snapshot is not None else train
            tables["account_id"] = crm.pid_aggregates(source)
        # fitted state is small and fixed: written once, not recomputed per use
        tables = {name: pin(table) for name, table in tables.items()}
        prior = train.agg(F.avg(self.label)).first()[0]
        return FittedAccountFeatures(self.row_id, self.label, self.mode, self.smoothing, self.folds, float(prior), tables)

    def fit_transform(self, train: DataFrame) -> tuple["FittedAccountFeatures", DataFrame]:
        """Fitted state, and the training rows encoded out of fold."""
        fitted = self.fit(train)
        return fitted, fitted.transform_training(train)


class FittedAccountFeatures(Model):
    def __init__(self, row_id: str, label: str, mode: str, smoothing: float, folds: int, prior: float, tables: dict[str, DataFrame]) -> None:
        super().__init__()
        self.row_id, self.label, self.mode = row_id, label, mode
        self.smoothing, self.folds, self.prior, self.tables = smoothing, folds, prior, tables

    @property
    def feature_columns(self) -> list[str]:
        if self.mode == "core":
            return [*BASE, *CORE_RATIOS]
        columns = [*BASE, *crm.derived_features(), "zip_bucket"]
        columns += [f"{f}_{n}" for n in crm.SCALED for f in ("log1p", "sqrt")]
        for c in categories_of(self.mode):
            columns += [f"{c}_ord", f"{c}_freq"]
        if self.mode.startswith("encoded"):
            columns += [f"{c}_{k}" for c in categories_of(self.mode) for k in ("rate", "woe")]
        if "account_id" in self.tables:
            columns += [c for c in self.tables["account_id"].columns if c != "account_id"]
            columns += ["pid_revenue_share", "pid_subs_share", "pid_revenue_vs_mean", "pid_arpu_vs_mean"]
        return list(dict.fromkeys(columns))

    def _defaults(self, c: str) -> dict:
        base = {f"{c}_ord": F.lit(-1).cast("bigint"), f"{c}_freq": F.lit(0.0)}
        if self.mode.startswith("encoded"):
            base |= {f"{c}_rate": F.lit(self.prior), f"{c}_woe": logit(F.lit(self.prior))}
        return base

    def _wide(self, dataset: DataFrame, skip_target: bool) -> DataFrame:
        rows = crm.with_derived(crm.prepared(dataset))
        for c, table in self.tables.items():
            if c == "account_id":
                rows = crm.with_pid_features(rows, table)
                continue
            defaults = self._defaults(c)
            if skip_target:
                table = table.select(c, f"{c}_ord", f"{c}_freq")
                defaults = {k: v for k, v in defaults.items() if k.endswith(("_ord", "_freq"))}
            rows = encoders.lookup(rows, table, c, defaults)
        return rows

    def _finish(self, rows: DataFrame) -> DataFrame:
        keep = [c for c in (self.row_id, self.label) if c in rows.columns]
        features = self.feature_columns
        crm.assert_no_ids([c for c in features if not c.startswith(crm.SEGMENT_CODES)])
        return sanitised(rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]), keep=keep)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._finish(self._wide(dataset, skip_target=False))

    def transform_training(self, train: DataFrame) -> DataFrame:
        """Training rows: target encodings come from the other folds."""
        if not self.mode.startswith("encoded"):
            return self._transform(train)
        # read by every encoding below, and the end of a long plan: written once
        rows = pin(stratified_folds(self._wide(train, skip_target=True), self.row_id, self.label, "42", self.folds, out="_fold"))
        wide = rows
        for c in categories_of(self.mode):
            table = encoders.out_of_fold_table(rows, c, self.label, "_fold", self.smoothing, c)
            wide = wide.join(table, [c, "_fold"], "left")
        return self._finish(wide)

    def save_tables(self, path: str) -> None:
        """The fitted state as small parquet tables."""
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name}")

    def with_saved_tables(self, spark: SparkSession, path: str, names: Sequence[str]) -> "FittedAccountFeatures":
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
        return FittedAccountFeatures(self.row_id, self.label, self.mode, self.smoothing, self.folds, self.prior, tables)
