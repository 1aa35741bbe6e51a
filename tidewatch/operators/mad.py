"""Robust z-score detector: distance from the median in units of the median absolute deviation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scoring import MAD_FLOOR, MAD_SCALE, robust_z
from tidewatch.operators.order_stats import percentile_rank
from tidewatch.operators.split import Series
from tidewatch.session import settle


def with_mad(
    series: Series, value: str, model: str, percentile: float = 95.0, floor: float = MAD_FLOOR
) -> Series:
    """Attach ``model``: the ``median``, ``mad`` and ``threshold`` of the fit window, as a struct.

    The score grows with the deviation, so one set of deviation ranks gives both the MAD and the
    threshold.
    """
    n = F.col("n")
    middle = {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)}
    half: Column = (F.col("lower") + F.col("upper")) / 2
    centered = series.with_fit_ranks(value, middle)
    rows = centered.rows.withColumn("median", half).drop("lower", "upper")
    rows = rows.withColumn("deviation", F.abs(F.col(value) - F.col("median")))
    spread = series.with_rows(rows).with_fit_ranks(
        "deviation", {**middle, "top": percentile_rank(n, percentile)}
    )
    rows = spread.rows.withColumn("mad", F.greatest(half, F.lit(floor)))
    threshold = F.col("top") / (F.lit(MAD_SCALE) * F.col("mad"))
    parts = F.struct("median", "mad", threshold.alias("threshold"))
    return series.with_rows(
        rows.withColumn(model, parts).drop("lower", "upper", "top", "deviation", "median", "mad")
    )


@dataclass(frozen=True)
class MadDetector:
    """Univariate detector; its own flag uses ``percentile`` of the fit scores."""

    name: str = "mad"
    value_key: str = "value"
    percentile: float = 95.0

    @property
    def feature_keys(self) -> tuple[str, ...]:
        return (self.value_key,)

    def fit(self, series: Series) -> DataFrame:
        """Settled ``median``, ``mad`` and ``threshold`` per series."""
        fitted = with_mad(series, self.value_key, "model", self.percentile)
        model = F.any_value("model").alias("model")
        return settle(
            fitted.rows.groupBy(*series.keys).agg(model).select(*series.keys, "model.*")
        )

    def score(self, series: Series, model: DataFrame) -> DataFrame:
        """Add the detector's score, its score within the fit window and its flag."""
        packed = F.struct("median", "mad", "threshold").alias(f"model__{self.name}")
        return self._scored(series.rows.join(model.select(*series.keys, packed), list(series.keys)))

    def fit_and_score(self, series: Series) -> tuple[DataFrame, None]:
        """Both in the same pass, without a model table in between."""
        fitted = with_mad(series, self.value_key, f"model__{self.name}", self.percentile)
        return self._scored(fitted.rows), None

    def _scored(self, rows: DataFrame) -> DataFrame:
        model = F.col(f"model__{self.name}")
        z = robust_z(F.col(self.value_key), model.median, model.mad)
        return rows.withColumns(
            {
                f"score__{self.name}": z,
                f"fit_score__{self.name}": z,
                f"flag__{self.name}": z > model.threshold,
            }
        )
