from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.data import labelled_rows

from tidewatch.config import DEFAULT_DETECT, DetectConfig, DetectorConfig
from tidewatch.operators import forest as forest_module
from tidewatch.operators.ensemble import score_ensemble
from tidewatch.operators.forest import ForestDetector
from tidewatch.operators.mad import MadDetector
from tidewatch.operators.registry import Detector, build_detector, register_detector
from tidewatch.operators.split import fit_split, fit_splits
from tidewatch.plans.explain import explain_alerts
from tidewatch.functions.scoring import normalize_weights
from tidewatch.functions import trees
from tidewatch.functions.trees import PATH_UNIT, Forest, average_path, build_tree


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.createDataFrame(labelled_rows(), "idx bigint, value double, label boolean")
    return rows.withColumn("series", F.lit("a"))


def detectors():
    return [build_detector(item) for item in DEFAULT_DETECT.detectors]


def quality(flagged: list) -> tuple[float, float, float]:
    tp = sum(r["label"] and r["flag"] for r in flagged)
    found, truth = sum(r["flag"] for r in flagged), sum(r["label"] for r in flagged)
    precision, recall = tp / found, tp / truth
    return precision, recall, 2 * precision * recall / (precision + recall)


def test_fit_window_size(spark):
    for n, ratio, want in ((100, 0.8, 80), (12, 0.8, 10), (10, 0.8, 9), (100, 0.29, 28), (1000, 0.8, 800)):
        rows = spark.range(n).select(F.lit("s").alias("series"), F.col("id"))
        assert fit_split(rows, ["series"], ["id"], ratio).fit_rows.count() == want


def test_short_series_are_left_out(spark):
    rows = spark.range(29).select(F.when(F.col("id") < 9, "short").otherwise("long").alias("s"), "id")
    assert {r["s"] for r in fit_split(rows, ["s"], ["id"]).rows.collect()} == {"long"}


def test_mad_of_a_known_series(spark):
    values = [float(v) for v in range(1, 11)] + [100.0, 5.5]
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "s string, i int, value double")
    series = fit_split(rows, ["s"], ["i"], 0.8)
    model = MadDetector().fit(series).first()
    assert model["median"] == 5.5
    assert model["mad"] == 2.5
    assert model["threshold"] == pytest.approx(4.5 / (1.4826 * 2.5))
    scored = {r["i"]: r for r in MadDetector().fit_and_score(series)[0].collect()}
    assert scored[10]["score__mad"] == pytest.approx(94.5 / (1.4826 * 2.5))
    assert scored[10]["flag__mad"] and not scored[11]["flag__mad"]


def test_constant_series_has_a_floor(spark):
    rows = spark.range(20).select(F.lit("s").alias("s"), "id", F.lit(3.0).alias("value"))
    series = fit_split(rows, ["s"], ["id"])
    assert MadDetector().fit(series).first()["mad"] == 1e-9
    scored = score_ensemble(series, detectors(), [0.5, 0.5]).rows.collect()
    assert all(r["ensemble"] == 0.0 and not r["is_anomaly"] for r in scored)


def test_model_can_be_kept_and_applied(labelled):
    series = fit_split(labelled, ["series"], ["idx"])
    detector = MadDetector()
    one = detector.fit_and_score(series)[0].select("idx", "score__mad", "flag__mad").collect()
    two = detector.score(series, detector.fit(series)).select("idx", "score__mad", "flag__mad").collect()
    assert sorted(one) == sorted(two)


def test_quality_floors(labelled):
    series = fit_split(labelled, ["series"], ["idx"])
    scored = score_ensemble(series, detectors(), [0.5, 0.5]).rows.collect()
    f1 = {}
    for name, column in (("mad", "flag__mad"), ("forest", "flag__isolation_forest"), ("both", "is_anomaly")):
        flagged = [{"label": r["label"], "flag": r[column]} for r in scored]
        precision, recall, f1[name] = quality(flagged)
        assert recall > 0.7 and precision > 0.6, name
    assert f1["both"] >= 0.85 * max(f1["mad"], f1["forest"])


def test_long_series_give_the_same_scores(labelled, monkeypatch):
    from tidewatch.operators import order_stats

    def run():
        series = fit_split(labelled, ["series"], ["idx"])
        rows = score_ensemble(series, detectors(), [0.5, 0.5]).rows
        return sorted(rows.select("idx", "ensemble", "threshold", "is_anomaly", "flag__isolation_forest").collect())

    short = run()
    monkeypatch.setattr(order_stats, "SORTABLE_ROWS", 100)
    monkeypatch.setattr(forest_module, "BROADCAST_SERIES", 0)
    monkeypatch.setattr(forest_module, "ROWS_PER_GROUP", 150)
    assert run() == short


def test_long_and_short_series_are_handled_apart(spark, labelled, monkeypatch):
    from tidewatch.operators import order_stats

    short = labelled.where("idx < 60").withColumn("series", F.lit("b"))
    both = labelled.unionByName(short)
    whole = fit_split(both, ["series"], ["idx"])
    want = sorted(MadDetector().fit_and_score(whole)[0].select("series", "idx", "score__mad", "flag__mad").collect())
    monkeypatch.setattr(order_stats, "SORTABLE_ROWS", 100)
    parts = fit_splits(both, ["series"], ["idx"])
    assert sorted(p.compact for p in parts) == [False, True]
    got = []
    for part in parts:
        got += MadDetector().fit_and_score(part)[0].select("series", "idx", "score__mad", "flag__mad").collect()
    assert sorted(got) == want


def test_forest_does_not_depend_on_partitions_or_order(labelled):
    def run(frame):
        series = fit_split(frame, ["series"], ["idx"])
        detector = ForestDetector()
        return sorted(detector.score(series, detector.fit(series)).select("idx", "score__isolation_forest").collect())

    first = run(labelled.coalesce(1))
    assert run(labelled.repartition(5, F.rand(1))) == first


def test_batch_scores_span_zero_to_one(labelled):
    series = fit_split(labelled, ["series"], ["idx"])
    detector = ForestDetector()
    scores = [r[0] for r in detector.score(series, detector.fit(series)).select("score__isolation_forest").collect()]
    assert min(scores) == 0.0 and max(scores) == 1.0


def test_average_path():
    assert average_path(1) == 0.0 and average_path(2) == 1.0
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


@pytest.mark.parametrize("features", [1, 3])
def test_tree_isolates_every_point(features):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(64, features))
    nodes = build_tree(points, seed=1, tree=0, depth_limit=18)
    leaves = int((nodes["feature"] < 0).sum())
    assert leaves == 64
    for point in points:
        node, depth = 0, 0
        while nodes["feature"][node] >= 0:
            goes_left = point[nodes["feature"][node]] <= nodes["cut"][node]
            node, depth = nodes["left" if goes_left else "right"][node], depth + 1
        assert nodes["path"][node] == depth * PATH_UNIT


def test_step_function_equals_walking_the_trees(labelled):
    series = fit_split(labelled, ["series"], ["idx"])
    nodes = ForestDetector().fit(series).drop("series").toArrow()
    trees = Forest.from_table(nodes)
    points = np.concatenate([np.linspace(-60, 90, 500), trees.step[0][:200]]).reshape(-1, 1)
    fast = trees.sample_scores(points)
    trees.step = None
    assert np.allclose(fast, trees.sample_scores(points), rtol=1e-12)


def test_outlier_scores_lowest(spark):
    rng = np.random.default_rng(0)
    rows = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    rows[250] = ("s", 250, 8.0, -8.0)
    frame = spark.createDataFrame(rows, "s string, i int, a double, b double")
    series = fit_split(frame, ["s"], ["i"])
    detector = ForestDetector("f", ("a", "b"))
    scored = detector.score(series, detector.fit(series))
    assert scored.orderBy(F.desc("score__f")).first()["i"] == 250


def test_weights():
    assert normalize_weights([1.0, 3.0]) == [0.25, 0.75]
    with pytest.raises(ValueError):
        normalize_weights([0.0])


def test_config_bounds():
    item = DetectorConfig("m", "mad")
    for bad in ({"percentile": 100.0}, {"fit_ratio": 1.0}, {"fit_ratio": 0.0}):
        with pytest.raises(ValueError):
            DetectConfig((item,), **bad)
    with pytest.raises(ValueError):
        DetectConfig(())
    with pytest.raises(ValueError):
        DetectorConfig("m", "mad", 0.0)
    with pytest.raises(ValueError, match="Unknown detector type"):
        build_detector(DetectorConfig("x", "unheard_of"))


class RangeDetector:
    """A detector of one's own: distance from the middle of the fit range."""

    name = "range"
    feature_keys = ("value",)

    def fit(self, series):
        return series.fit_rows.groupBy(*series.keys).agg(F.min("value").alias("a"), F.max("value").alias("b"))

    def score(self, series, model):
        distance = F.abs(F.col("value") - (F.col("a") + F.col("b")) / 2)
        return (
            series.rows.join(model, list(series.keys))
            .withColumn("score__range", distance)
            .withColumn("fit_score__range", distance)
            .withColumn("flag__range", (F.col("value") < F.col("a")) | (F.col("value") > F.col("b")))
            .drop("a", "b")
        )


def test_own_detector(labelled):
    register_detector("range", lambda name, params: RangeDetector())
    own = build_detector(DetectorConfig("range", "range"))
    assert isinstance(own, Detector)
    series = fit_split(labelled, ["series"], ["idx"])
    both = [MadDetector(), own]
    result = score_ensemble(series, both, [0.5, 0.5])
    alerts = result.rows.where("is_anomaly")
    alerts = alerts.withColumn("observed_at", F.timestamp_seconds("idx"))
    explained = explain_alerts(alerts, series, both, result.models, [0.5, 0.5])
    part = explained.first()["explanation"]["detectors"][1]
    assert part["detector"] == "range" and part["summary"].startswith("range scores ")
    assert part["contributions"] == {} and len(part["rules"]) == 1


def test_plan_has_one_shuffle_for_short_series(labelled):
    rows = labelled.withColumn("series", F.col("idx") % 2)
    series = fit_split(rows, ["series"], ["idx"])
    two = [MadDetector("a"), MadDetector("b")]
    rows = score_ensemble(series, two, [0.5, 0.5]).rows.select("idx", "is_anomaly")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan


def test_every_fit_row_can_enter_a_tree(spark):
    """More fit rows than any pool: trees draw from all of them, alike on both branches."""
    drawn = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 40_000)
    whole = np.arange(40_000.0).reshape(-1, 1)
    some = trees.may_be_drawn(drawn, np.full(40_000, 40_000))
    assert 8192 < some.sum() < 40_000
    taken = trees.grow_forest(whole, drawn, 40_000, "x")
    part = trees.grow_forest(whole[some], drawn[some], 40_000, "x")
    assert all(np.array_equal(a["cut"], b["cut"]) for a, b in zip(taken, part, strict=True))


def test_ambiguous_keys_have_forests_of_their_own(spark, monkeypatch):
    rows = spark.range(60).select(
        F.when(F.col("id") < 30, "a|b").otherwise("a").alias("s"),
        F.when(F.col("id") < 30, "c").otherwise("b|c").alias("t"),
        "id", (F.col("id") * F.col("id") % 37).cast("double").alias("value"),
    )
    series = fit_split(rows, ["s", "t"], ["id"])
    detector = ForestDetector()
    model = detector.fit(series)
    shipped = {r["id"]: r["score__isolation_forest"] for r in detector.score(series, model).collect()}
    monkeypatch.setattr(forest_module, "BROADCAST_SERIES", 0)
    joined = {r["id"]: r["score__isolation_forest"] for r in detector.score(series, model).collect()}
    assert shipped == joined


def test_long_series_replace_an_incoming_n(spark, labelled, monkeypatch):
    """Rows that already carry ``n`` (as ranked events do) are fitted and scored on the long path too."""
    from tidewatch.operators import order_stats

    rows = labelled.withColumn("n", F.lit(12345).cast("bigint"))
    want = sorted(fit_split(rows, ["series"], ["idx"]).rows.select("idx", "n", "is_fit").collect())
    monkeypatch.setattr(order_stats, "SORTABLE_ROWS", 100)
    series = fit_split(rows, ["series"], ["idx"])
    assert not series.compact
    assert sorted(series.rows.select("idx", "n", "is_fit").collect()) == want
    weights = [item.weight for item in DEFAULT_DETECT.detectors]
    scored = score_ensemble(series, detectors(), weights, DEFAULT_DETECT.percentile)
    assert scored.rows.count() == rows.count()
