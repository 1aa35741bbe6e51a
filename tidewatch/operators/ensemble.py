"""Weighted fusion of detectors with a threshold calibrated on the fit window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scoring import min_max, normalize_weights, weighted_sum
from tidewatch.operators.order_stats import percentile_rank
from tidewatch.operators.registry import Detector
from tidewatch.operators.split import Series


def fit_and_score(detector: Detector, series: Series) -> tuple[DataFrame, DataFrame | None]:
    """Scored rows and model of one detector, in a single pass where the detector can."""
    if hasattr(detector, "fit_and_score"):
        return detector.fit_and_score(series)
    model = detector.fit(series)
    return detector.score(series, model), model


def with_score_bounds(series: Series, names: Sequence[str]) -> Series:
    """Attach the smallest and largest fit score of each detector."""
    bounds: dict[str, Column] = {}
    for name in names:
        score = F.when(F.col("is_fit"), F.col(f"fit_score__{name}"))
        bounds |= {f"low__{name}": F.min(score), f"high__{name}": F.max(score)}
    return series.with_aggregates(bounds)


@dataclass(frozen=True)
class Scored:
    """Every row with its detector scores, ``ensemble``, ``threshold`` and ``is_anomaly``, and the
    model tables of the detectors that have one."""

    rows: DataFrame
    models: dict[str, DataFrame | None]


def score_ensemble(
    series: Series,
    detectors: Sequence[Detector],
    weights: Sequence[float],
    percentile: float = 95.0,
) -> Scored:
    """Fit each detector on the fit windows and score all rows of all series.

    Adds ``score__``, ``fit_score__`` and ``flag__`` per detector, the combined ``ensemble`` score,
    its ``threshold`` (the floor percentile of the combined fit scores) and ``is_anomaly``, which is
    true strictly above it.
    """
    if not detectors:
        raise ValueError("At least one detector is required")
    names = [d.name for d in detectors]
    weights = normalize_weights(weights)

    models: dict[str, DataFrame | None] = {}
    scored = series
    for detector in detectors:
        rows, models[detector.name] = fit_and_score(detector, scored)
        scored = scored.with_rows(rows)
    bounded = with_score_bounds(scored, names)

    def combined(prefix: str) -> Column:
        parts = [min_max(F.col(f"{prefix}{n}"), F.col(f"low__{n}"), F.col(f"high__{n}")) for n in names]
        return weighted_sum(parts, weights)

    both = bounded.with_rows(
        bounded.rows.withColumns(
            {"ensemble": combined("score__"), "fit_ensemble": combined("fit_score__")}
        )
    )
    ranks = {"threshold": percentile_rank(F.col("n"), percentile)}
    calibrated = both.with_fit_ranks("fit_ensemble", ranks)
    rows = calibrated.rows.withColumn("is_anomaly", F.col("ensemble") > F.col("threshold")).drop(
        "fit_ensemble", *[f"low__{n}" for n in names], *[f"high__{n}" for n in names]
    )
    return Scored(rows, models)


def scores_long(scored: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per observation and detector, the ensemble included."""
    entries = [
        F.struct(
            F.lit(n).alias("detector"),
            F.col(f"score__{n}").alias("score"),
            F.col(f"flag__{n}").alias("is_anomaly"),
        )
        for n in names
    ]
    entries.append(
        F.struct(
            F.lit("ensemble").alias("detector"),
            F.col("ensemble").alias("score"),
            F.col("is_anomaly").alias("is_anomaly"),
        )
    )
    return scored.select(*ids, F.explode(F.array(*entries)).alias("entry")).select(*ids, "entry.*")
