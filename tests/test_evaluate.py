from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F
from tests.data import labelled_rows, write_csv

from tidewatch.config import BenchmarkConfig, LabelledCsvDataset, SyntheticDataset
from tidewatch.functions.hashing import gaussian
from tidewatch.operators.inject import (
    KINDS,
    baseline_series,
    inject,
    labelled_records,
    sample_series,
    select_indices,
)
from tidewatch.operators.metrics import (
    classification_counts,
    false_positives_per_hour,
    precision_recall_f1,
    set_counts,
)
from tidewatch.plans.evaluate import run_benchmark, synthetic_dataset, write_benchmark


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id int")


def test_counts_of_two_sets(spark):
    counts = set_counts(ids(spark, [1, 2, 3, 4, 5]), ids(spark, [3, 4, 5, 6, 7]), ["id"])
    row = precision_recall_f1(counts).first()
    assert (row["true_positives"], row["false_positives"], row["false_negatives"]) == (3, 2, 2)
    assert row["precision"] == row["recall"] == pytest.approx(0.6)
    assert row["f1"] == pytest.approx(0.6)


def test_empty_sets_have_zero_quality(spark):
    flags = spark.createDataFrame([(False, False)], "label boolean, flag boolean")
    row = precision_recall_f1(classification_counts(flags, "label", "flag")).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_false_positives_per_hour(spark):
    row = spark.range(1).select(
        false_positives_per_hour(F.lit(12), F.lit(6.0)), false_positives_per_hour(F.lit(12), F.lit(0.0))
    ).first()
    assert tuple(row) == (2.0, 0.0)


def series(spark, n=400):
    return baseline_series(spark, n).withColumns({"s": F.lit("a"), "n": F.lit(n).cast("bigint")})


def test_baseline_shape(spark):
    noise = spark.range(20_000).select(gaussian("seed", F.col("id")).alias("g"))
    row = noise.agg(F.avg("g"), F.stddev("g"), F.max(F.abs("g"))).first()
    assert abs(row[0]) < 0.03 and abs(row[1] - 1) < 0.03 and row[2] > 3
    values = [r["value"] for r in baseline_series(spark, 200).orderBy("idx").collect()]
    assert all(abs(v - 20 - math.sin(i / 25)) < 3 for i, v in enumerate(values))


def test_places_are_distinct_and_in_the_middle(spark, long_series):
    places = [r["idx"] for r in select_indices(series(spark), ["s"], 60, 1).collect()]
    assert len(set(places)) == len(places) == 60
    assert min(places) >= 40 and max(places) < 360


@pytest.mark.parametrize("kind", KINDS)
def test_one_kind(spark, kind):
    before = {r["idx"]: r["value"] for r in series(spark).collect()}
    after = {r["idx"]: r for r in inject(series(spark), ["s"], 10, [kind], 3).collect()}
    placed = [i for i, r in after.items() if r["kind"] == kind]
    assert len(placed) == 10 and len(after) == 400
    for i, row in after.items():
        change = row["value"] - before[i]
        if not row["label"]:
            assert change == 0
        elif kind == "point":
            assert 20 <= abs(change) <= 40
        elif kind == "contextual":
            mean = sum(before[j] for j in range(i - 5, i)) / 5
            assert 8 <= row["value"] - mean <= 15
        else:
            assert change > 5 * math.exp(-0.3 * 4) - 1e-9
    if kind == "drift":
        assert {j for i in placed for j in range(i, i + 5)} == {i for i, r in after.items() if r["label"]}


def test_injection_is_reproducible(spark):
    one = inject(series(spark), ["s"], 20, seed=9)
    two = inject(series(spark).repartition(7), ["s"], 20, seed=9)
    other = inject(series(spark), ["s"], 20, seed=10)
    assert sorted(one.collect()) == sorted(two.select(one.columns).collect())
    assert sorted(map(str, one.collect())) != sorted(map(str, other.collect()))


def test_nothing_to_inject_and_too_much(spark):
    assert inject(series(spark), ["s"], 0).where("label").count() == 0
    for n_anomalies in (400, 321):
        with pytest.raises(Exception, match="more anomalies than places"):
            select_indices(series(spark), ["s"], n_anomalies, 1).collect()
    assert select_indices(series(spark), ["s"], 320, 1).count() == 320
    with pytest.raises(ValueError, match="unknown anomaly kinds"):
        inject(series(spark), ["s"], 5, ["odd"])


def test_synthetic_dataset(spark):
    rows = synthetic_dataset(spark, SyntheticDataset(n_samples=200, n_anomalies=5), 1).orderBy("idx").collect()
    assert len(rows) == 200 and str(rows[1]["observed_at"]) == "2024-01-01 00:01:00"
    with pytest.raises(ValueError):
        SyntheticDataset(n_samples=10)


def test_point_benchmark_meets_its_floors(spark, tmp_path):
    config = BenchmarkConfig(dataset=SyntheticDataset(anomaly_types=("point",)))
    report = run_benchmark(spark, config)
    rows = report.collect()
    assert [r["detector"] for r in rows] == ["mad", "isolation_forest", "ensemble"]
    for row in rows:
        assert row["recall"] > 0.7 and row["precision"] > 0.6
        assert (row["n_samples"], row["n_anomalies"], row["fit_samples"]) == (1000, 50, 800)
        assert row["predict_ms"] > 0 and row["duration_hours"] == 16.6667
    path = write_benchmark(report, str(tmp_path))
    assert spark.read.json(path).count() == 3


def test_benchmark_on_a_labelled_file(spark, tmp_path):
    data = [(f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", v, int(a)) for i, v, a in labelled_rows()]
    path = write_csv(tmp_path / "b.csv", data, "timestamp,value,label")
    rows = run_benchmark(spark, BenchmarkConfig(dataset=LabelledCsvDataset(path))).collect()
    assert all(r["n_anomalies"] == 50 and r["recall"] > 0.7 for r in rows)


def test_contextual_anomaly_replaces_an_earlier_drift(spark):
    """In a series of zeros, its value is the rise over the zeros before it, whatever drifts there."""
    rows = spark.range(400).select(
        F.lit("s").alias("s"), F.col("id").alias("idx"), F.lit(400).cast("bigint").alias("n"), F.lit(0.0).alias("value")
    )
    found = inject(rows, ["s"], 200, ("contextual", "drift"), 7).where("kind = 'contextual'")
    assert found.where("value < 8 or value >= 15").count() == 0


@pytest.mark.parametrize("wanted, marked", [(0, 0), (7, 7), (500, 30)])
def test_samples_have_exactly_as_many_marked_rows(spark, wanted, marked):
    rows = spark.range(60).select((F.col("id") % 2).alias("s"), F.floor(F.col("id") / 2).alias("idx"))
    made = {tuple(r) for r in sample_series(rows, ["s"], wanted).select("s", "idx", "value", "spike").collect()}
    again = sample_series(rows.repartition(3), ["s"], wanted).select("s", "idx", "value", "spike")
    assert made == {tuple(r) for r in again.collect()}
    assert [sum(r[3] for r in made if r[0] == s) for s in (0, 1)] == [marked, marked]
    assert all((r[2] > 40) == r[3] for r in made)
    records = labelled_records(rows, ["s"], wanted).collect()
    assert sum(r["label"] for r in records) == 2 * marked
    assert all((abs(r["value"] - 20) > 10) == r["label"] for r in records)


def test_samples_of_long_series(spark, long_series):
    rows = spark.range(200).select(F.lit("a").alias("s"), F.col("id").alias("idx"))
    assert labelled_records(rows, ["s"], 60).where("label").count() == 60
    assert sample_series(rows.limit(0), ["s"], 5).count() == 0
