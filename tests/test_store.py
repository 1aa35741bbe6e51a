from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from tests.data import sample_rows, write_csv

from tidewatch.config import DEFAULT_DETECT, DetectConfig, DetectorConfig, FileSourceConfig
from tidewatch.operators import order_stats
from tidewatch.plans import reports
from tidewatch.plans.detect import detect
from tidewatch.plans.ingest import ingest, ingest_records
from tidewatch.tables.publish import publish_json, write_files
from tidewatch.tables.store import (
    TableStore,
    backfill_fingerprints,
    duplicate_fingerprints,
    latest_runs,
)

TWO_MADS = DetectConfig(
    (DetectorConfig("first", "mad", 1.0), DetectorConfig("second", "mad", 3.0, {"value_key": "value"}))
)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def sample(tmp_path):
    path = write_csv(tmp_path / "sample.csv", sample_rows(500, 25))
    return FileSourceConfig("sample", path=path)


def test_second_ingest_is_skipped(store, sample):
    first = ingest(store, sample).collect()
    again = ingest(store, sample).collect()
    assert len(first) == len(again) == 1
    assert (first[0]["records_read"], first[0]["records_written"], first[0]["skipped"]) == (500, 500, False)
    assert (again[0]["records_read"], again[0]["records_written"], again[0]["skipped"]) == (500, 0, True)
    assert first[0]["run_id"] == again[0]["run_id"]
    assert store.observations().count() == 500
    assert store.streams().count() == 1


def test_reordered_lines_are_the_same_content(store, sample, tmp_path):
    ingest(store, sample)
    rows = sample_rows(500, 25)[::-1]
    other = FileSourceConfig("sample", path=write_csv(tmp_path / "other.csv", rows))
    assert ingest(store, other).first()["skipped"]


def test_overlap_is_stored_once_and_the_first_run_keeps_it(store, sample, tmp_path):
    first = ingest(store, sample).first()
    longer = FileSourceConfig("sample", path=write_csv(tmp_path / "b.csv", sample_rows(500, 25) + [
        (dt.datetime(2024, 2, 1, 0, i), 1.0) for i in range(7)
    ]))
    second = ingest(store, longer).first()
    assert (second["records_written"], second["records_duplicate"]) == (7, 500)
    counts = reports.count_observations(store.observations(), "run_id").collect()
    assert {r["run_id"]: r["observations"] for r in counts} == {first["run_id"]: 500, second["run_id"]: 7}


def test_failed_ingest_is_recorded_and_can_be_retried(store, sample, monkeypatch):
    monkeypatch.setattr(TableStore, "append_observations", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest(store, sample)
    run = store.runs().first()
    assert run["status"] == "failed" and "zero" in run["metadata"]["error"]
    monkeypatch.undo()
    assert ingest(store, sample).first()["records_written"] == 500
    runs = store.runs().collect()
    assert [r["status"] for r in runs] == ["completed"]


def test_empty_source_completes_with_no_rows(store, tmp_path):
    config = FileSourceConfig("none", path=write_csv(tmp_path / "n.csv", []))
    result = ingest(store, config).first()
    assert (result["records_read"], result["records_written"]) == (0, 0)


def many(spark, streams: int, rows: int):
    return spark.range(streams * rows).select(
        F.concat(F.lit("s"), (F.col("id") % streams).cast("string")).alias("stream_name"),
        F.timestamp_seconds(1704067200 + F.floor(F.col("id") / streams) * 60).alias("observed_at"),
        (F.rand(7) + F.when(F.rand(8) > 0.96, 50.0).otherwise(0.0)).alias("value"),
    ).withColumn("payload", F.to_json(F.struct("value")))


def test_many_streams_in_one_job(spark, store):
    rows = many(spark, 70, 20).unionByName(many(spark, 1, 5).withColumn("stream_name", F.lit("short")))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    result = ingest_records(store, rows, "table", {}).collect()
    assert len(result) == 71 and sum(r["records_written"] for r in result) == 1405
    found = {r["stream_name"]: r for r in detect(store).collect()}
    assert found["short"]["status"] == "failed"
    done = [r for r in found.values() if r["status"] == "completed"]
    assert len(done) == 70 and all(r["observations_scored"] == 20 for r in done)
    errors = store.runs().where("status = 'failed'").collect()
    assert ["need >= 10, got 5" in r["metadata"]["error"] for r in errors] == [True]


def test_detect_stores_scores_alerts_and_runs(store, sample, monkeypatch):
    ingest(store, sample)
    seen = []
    first = detect(store, streams=["sample"], on_alerts=lambda a: seen.append(a.count())).first()
    assert first["observations_scored"] == 500 and first["alerts_created"] > 0
    scores = store.read("scores")
    assert scores.count() == 1500
    flagged = scores.where("detector = 'ensemble' and is_anomaly").count()
    alerts = store.alerts()
    assert alerts.count() == flagged == first["alerts_created"] == seen[0]
    created = {r["alert_id"]: r["created_at"] for r in alerts.collect()}

    again = detect(store, streams=["sample"]).first()
    assert again["alerts_created"] == 0
    after = store.alerts().collect()
    assert {r["alert_id"]: r["created_at"] for r in after} == created
    assert {r["run_id"] for r in after} == {again["run_id"]}

    # The long-series way finds the same alerts.
    monkeypatch.setattr(order_stats, "SORTABLE_ROWS", 60)
    third = detect(store).first()
    assert third["ensemble_threshold"] == first["ensemble_threshold"]
    assert {r["alert_id"]: r["score"] for r in store.alerts().collect()} == {r["alert_id"]: r["score"] for r in after}

    stream = store.streams().first()["stream_id"]
    runs = reports.list_runs(store.runs(), stream).collect()
    assert [r["run_type"] for r in runs] == ["detection"] * 3 + ["ingestion"]
    assert runs[0]["observations_scored"] == 500 and runs[-1]["records_written"] == 500
    assert reports.count_alerts_for_run(store.alerts(), third["run_id"]).first()["alerts"] == flagged
    listed = reports.list_streams(store.streams(), store.alerts()).first()
    assert (listed["name"], listed["alert_count"]) == ("sample", flagged)


def test_alert_reports(store, sample):
    ingest(store, sample)
    detect(store, streams=["sample"])
    stream = reports.stream_by_name(store.streams(), "sample").first()["stream_id"]
    newest = reports.alerts_for_stream(store.alerts(), store.observations(), stream, 5)
    assert newest.count() == 5
    assert reports.dashboard_alerts(newest).columns == ["observed_at", "score", "summary", "alert_id"]
    one = newest.first()["alert_id"]
    detail = reports.alert_detail(store.alerts(), store.streams(), store.observations(), one)
    row = detail.first()
    assert row["summary"].startswith("Together the detectors score ")
    assert {d["detector"] for d in row["detectors"]} == {"mad", "isolation_forest"}
    assert len(row["rules"]) == 1 + 4 + 3
    assert any("median" in rule for rule in row["rules"])
    mad = next(d for d in row["detectors"] if d["detector"] == "mad")
    assert mad["contributions"]["value"] == pytest.approx(row["detector_scores"]["mad"])
    forest = next(d for d in row["detectors"] if d["detector"] == "isolation_forest")
    share = 0.5 * mad["contributions"]["value"] + 0.5 * forest["contributions"]["value"]
    assert row["feature_contributions"]["value"] == pytest.approx(share, abs=1e-4)
    assert forest["contributions"]["value"] > 0
    payload = reports.notification_payload(detail)
    body = json.loads(payload.first()["body"])
    assert body["stream"] == "sample" and body["value"] == row["value"] and body["rules"] == row["rules"]
    assert "`sample`" in reports.chat_message(payload).first()["text"]
    view = reports.alert_explanations(detail).first()
    assert view["feature_contributions"] == row["feature_contributions"]
    for limit in (0, -1):
        with pytest.raises(ValueError):
            reports.alerts_for_stream(store.alerts(), store.observations(), stream, limit)
    with pytest.raises(ValueError, match="not found"):
        reports.stream_by_name(store.streams(), "absent")


def test_a_score_below_its_threshold_is_not_called_an_excess(store, sample):
    ingest(store, sample)
    detect(store, DetectConfig(DEFAULT_DETECT.detectors, percentile=50.0))
    alerts = store.alerts().select(F.explode("explanation.detectors").alias("d")).where("d.detector = 'mad'")
    last = [(r["d"]["details"], r["d"]["rules"][-1]) for r in alerts.collect()]
    over = [float(d["robust_z"]) > float(d["threshold"]) for d, _ in last]
    assert True in over and False in over
    assert all(("is within" in rule) != above for above, (_, rule) in zip(over, last, strict=True))


def test_own_detector_names_reach_the_explanation(store, sample):
    ingest(store, sample)
    detect(store, TWO_MADS)
    why = store.alerts().first()["explanation"]
    assert why["primary_detector"] == "first" and set(why["detector_scores"]) == {"first", "second"}


def test_detect_errors(store, spark, tmp_path):
    with pytest.raises(ValueError, match="not found"):
        detect(store, streams=["absent"])
    store.upsert_streams(spark.createDataFrame([("empty",)], "name string"), "csv_batch", {})
    with pytest.raises(ValueError, match="No completed ingestion run"):
        detect(store, streams=["empty"])
    ingest(store, FileSourceConfig("tiny", path=write_csv(tmp_path / "t.csv", sample_rows(9, 1))))
    with pytest.raises(ValueError, match="got 9"):
        detect(store, streams=["tiny"])


def test_missing_feature_fails_and_is_recorded(store, sample):
    ingest(store, sample)
    config = DetectConfig((DetectorConfig("m", "mad", 1.0, {"value_key": "absent"}),))
    with pytest.raises(Exception, match="lacks one of the features"):
        detect(store, config)


def test_delete_stream(store, sample, tmp_path):
    ingest(store, sample)
    ingest(store, FileSourceConfig("kept", path=write_csv(tmp_path / "k.csv", sample_rows(40, 2, 3))))
    detect(store, TWO_MADS)
    store.delete_stream("sample")
    kept = store.streams().collect()
    assert [r["name"] for r in kept] == ["kept"]
    for table in ("observations", "scores", "alert_versions", "run_events"):
        assert {r["stream_id"] for r in store.read(table).select("stream_id").collect()} <= {kept[0]["stream_id"]}
    assert store.observations().count() == 40


def test_stream_settings_change_in_place(store, spark):
    names = spark.createDataFrame([("a",)], "name string")
    store.upsert_streams(names, "csv_batch", {"path": "one"})
    store.upsert_streams(names, "csv_batch", {"path": "two"})
    row = store.streams().collect()
    assert len(row) == 1 and json.loads(row[0]["config"]) == {"path": "two"}
    assert row[0]["created_at"] < row[0]["updated_at"]


def test_run_metadata_is_merged(spark):
    events = spark.createDataFrame(
        [
            ("r", "s", "ingestion", "running", dt.datetime(2024, 1, 1), {"a": "1", "b": "1"}),
            ("r", "s", "ingestion", "completed", dt.datetime(2024, 1, 2), {"b": "2", "row_count": "5"}),
        ],
        "run_id string, stream_id string, run_type string, status string, event_at timestamp, metadata map<string,string>",
    )
    run = latest_runs(events).first()
    assert run["status"] == "completed" and run["metadata"] == {"a": "1", "b": "2", "row_count": "5"}
    assert run["started_at"].day == 1 and run["finished_at"].day == 2


def test_backfill(spark):
    rows = spark.createDataFrame(
        [("s", dt.datetime(2024, 1, 1), "{}", None), ("s", dt.datetime(2024, 1, 1), "{}", None), ("s", dt.datetime(2024, 1, 1), "{}", "x")],
        "stream_id string, observed_at timestamp, payload string, row_fingerprint string",
    )
    filled = backfill_fingerprints(rows)
    assert filled.where("row_fingerprint is null").count() == 0
    assert [r["copies"] for r in duplicate_fingerprints(filled).collect()] == [2]


def test_published_messages(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 42)], "timestamp timestamp, value int")
    write_files(publish_json(rows, "timestamp", "value", "demo"), str(tmp_path / "out"))
    body = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert body == {"timestamp": "2024-01-01T00:00:00+00:00", "value": 42.0, "source": "demo"}


def test_filters_reach_the_stored_tables(store, sample):
    ingest(store, sample)
    detect(store, TWO_MADS)
    for view in (store.alerts(), store.runs()):
        plan = view.where("stream_id = 'x'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(stream_id,x)" in plan


def test_settled_tables_can_be_released(spark, tmp_path, monkeypatch):
    from tidewatch import session

    root = tmp_path / "shared"
    monkeypatch.setattr(session, "_settled_root", lambda _: str(root))
    assert session.settle(spark.range(3)).count() == 3
    assert len(list(root.iterdir())) == 1
    session.release(spark)
    assert not root.exists()
