"""Detector benchmarks: fit on a prefix, flag everything, compare with the ground truth."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import BenchmarkConfig, LabelledCsvDataset, SyntheticDataset
from tidewatch.operators.ensemble import score_ensemble
from tidewatch.operators.inject import baseline_value, inject
from tidewatch.operators.metrics import (
    classification_counts,
    false_positives_per_hour,
    precision_recall_f1,
)
from tidewatch.operators.registry import build_detector
from tidewatch.operators.split import Series, fit_split
from tidewatch.session import configure, settle
from tidewatch.sources.labelled import labelled_csv


def synthetic_dataset(spark: SparkSession, config: SyntheticDataset, seed: int) -> DataFrame:
    """``idx``, ``observed_at``, ``value``, ``label`` of a synthetic series with anomalies."""
    if config.n_anomalies >= config.n_samples:
        raise ValueError("n_anomalies must be smaller than series length")
    rows = spark.range(config.n_samples).select(
        F.lit(0).alias("series"),
        F.col("id").alias("idx"),
        F.lit(config.n_samples).cast("bigint").alias("n"),
        baseline_value(F.col("id"), config.base_value, seed).alias("value"),
    )
    injected = inject(rows, ["series"], config.n_anomalies, config.anomaly_types, seed + 1)
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    moment = F.timestamp_micros(
        F.unix_micros(start) + F.col("idx") * (config.interval_seconds * 1_000_000)
    )
    return injected.select("idx", moment.alias("observed_at"), "value", "label", "kind")


def build_dataset(spark: SparkSession, config: BenchmarkConfig) -> DataFrame:
    if isinstance(config.dataset, LabelledCsvDataset):
        dataset = config.dataset
        return labelled_csv(
            spark,
            dataset.path,
            dataset.timestamp_column,
            dataset.value_column,
            dataset.label_column,
        )
    return synthetic_dataset(spark, config.dataset, config.seed)


def flags_long(rows: DataFrame, ids: Sequence[str], flags: Mapping[str, str]) -> DataFrame:
    """One row per observation and detector with the flag; ``flags`` maps detector to column."""
    entries = [
        F.struct(F.lit(name).alias("detector"), F.col(column).alias("flag"))
        for name, column in flags.items()
    ]
    return rows.select(*ids, F.explode(F.array(*entries)).alias("entry")).select(*ids, "entry.*")


def quality(flagged: DataFrame, keys: Sequence[str], interval_seconds: int) -> DataFrame:
    """Counts, precision, recall, F1 and false positives per hour, rounded to four places.

    ``flagged`` has the keys, ``label`` and ``flag``.
    """
    samples = F.count(F.lit(1)).alias("n_samples")
    rated = precision_recall_f1(classification_counts(flagged, "label", "flag", keys, [samples]))
    hours = F.col("n_samples") * F.lit(float(interval_seconds)) / F.lit(3600.0)
    per_hour = false_positives_per_hour(F.col("false_positives"), hours)
    return rated.select(
        *keys,
        "true_positives",
        "false_positives",
        "false_negatives",
        F.round("precision", 4).alias("precision"),
        F.round("recall", 4).alias("recall"),
        F.round("f1", 4).alias("f1"),
        F.round(per_hour, 4).alias("false_positives_per_hour"),
    )


def evaluate_series(
    parts: Sequence[Series], config: BenchmarkConfig, interval_seconds: int
) -> DataFrame:
    """Quality of each detector alone and of their ensemble, per series. Rows carry ``label``;
    ``parts`` come from ``fit_splits``."""
    detect = config.detect
    detectors = [build_detector(item) for item in detect.detectors]
    weights = [item.weight for item in detect.detectors]
    flags = {d.name: f"flag__{d.name}" for d in detectors} | {"ensemble": "is_anomaly"}
    rated = []
    for series in parts:
        scored = score_ensemble(series, detectors, weights, detect.percentile)
        long = flags_long(scored.rows, [*series.keys, "label"], flags)
        rated.append(quality(long, [*series.keys, "detector"], interval_seconds))
    return reduce(DataFrame.unionByName, rated)


def run_benchmark(spark: SparkSession, config: BenchmarkConfig = BenchmarkConfig()) -> DataFrame:
    """One row per detector, each alone and then the ensemble, with quality and latency.

    Latency is the wall clock of Spark jobs whose result is written out: fitting, then flagging.
    """
    configure(spark)
    rows = settle(build_dataset(spark, config).withColumn("series", F.lit(0)))
    detect, step = config.detect, config.dataset.interval_seconds
    series = fit_split(rows, ["series"], ["observed_at", "idx"], detect.fit_ratio)
    n, k = rows.count(), series.fit_rows.count()
    truth = rows.where("label").count()
    results: list[DataFrame] = []

    def add(name: str, flagged: DataFrame, fit_ms: float, predict_ms: float) -> None:
        rated = quality(flagged.withColumn("detector", F.lit(name)), ["detector"], step)
        results.append(
            rated.select(
                "*",
                F.lit(len(results)).alias("position"),
                F.lit(round(fit_ms, 3)).alias("fit_ms"),
                F.lit(round(predict_ms, 3)).alias("predict_ms"),
                F.lit(round(predict_ms / n, 6)).alias("predict_ms_per_sample"),
            )
        )

    detectors = [build_detector(item) for item in detect.detectors]
    for detector in detectors:
        started = time.perf_counter()
        model = detector.fit(series)
        fitted = time.perf_counter()
        flag = F.col(f"flag__{detector.name}").alias("flag")
        flagged = settle(detector.score(series, model).select("label", flag))
        done = time.perf_counter()
        add(detector.name, flagged, (fitted - started) * 1000, (done - fitted) * 1000)

    started = time.perf_counter()
    weights = [item.weight for item in detect.detectors]
    scored = score_ensemble(series, detectors, weights, detect.percentile)
    fitted = time.perf_counter()
    flagged = settle(scored.rows.select("label", F.col("is_anomaly").alias("flag")))
    done = time.perf_counter()
    add("ensemble", flagged, (fitted - started) * 1000, (done - fitted) * 1000)

    report = results[0]
    for part in results[1:]:
        report = report.unionByName(part)
    return report.select(
        "*",
        F.lit(config.seed).alias("seed"),
        F.lit(config.dataset.type).alias("dataset_type"),
        F.lit(n).alias("n_samples"),
        F.lit(truth).alias("n_anomalies"),
        F.lit(k).alias("fit_samples"),
        F.lit(round(n * step / 3600.0, 4)).alias("duration_hours"),
        F.current_timestamp().alias("generated_at"),
    ).orderBy("position").drop("position")


def write_benchmark(report: DataFrame, directory: str, prefix: str = "benchmark") -> str:
    """Write the report, a handful of rows, as one JSON file in a folder named by its time."""
    stamp = time.strftime("%Y%m%dT%H%M%SZ", time.gmtime())
    path = f"{directory.rstrip('/')}/{prefix}_{stamp}"
    report.coalesce(1).write.json(path)
    return path
