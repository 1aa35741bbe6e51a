"""States with a compacted snapshot: same answers whatever is merged, and deletion by a record."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.tables import log as state_log
from tidewatch.tables.store import TableStore, latest_runs, run_states

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
EVENT = (
    "run_id string, stream_id string, run_type string, status string, event_at timestamp, "
    "metadata map<string,string>"
)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def some_events(spark):
    """Runs with a start, an end and a retry, given out of order; one has no metadata."""
    rows = []
    for i in range(12):
        run, stream = f"r{i % 5}", f"s{i % 5 % 2}"
        status = ("completed", "running", "failed")[i % 3]
        about = None if i == 4 else {"n": str(i), f"only{i}": "x"}
        rows.append((run, stream, "ingestion", status, START + dt.timedelta(minutes=(i * 7) % 12), about))
    return spark.createDataFrame(rows, EVENT).coalesce(1)


def as_set(runs):
    return {
        (r["run_id"], r["stream_id"], r["status"], r["started_at"], r["finished_at"],
         tuple(sorted((r["metadata"] or {}).items())))
        for r in runs.collect()
    }


def test_compaction_keeps_few_parts_and_changes_nothing(spark, store, monkeypatch):
    monkeypatch.setattr(state_log, "MERGE_AT", 4)
    log, events = store.logs["run_events"], some_events(spark)
    wanted = as_set(latest_runs(events))
    for minute in range(12):
        at = START + dt.timedelta(minutes=minute)
        log.append(run_states(events.where(F.col("event_at") == F.lit(at))))
        assert len(log.parts()) < 4
    early = store.runs()
    assert as_set(early) == wanted
    # What is read is near one state per run, not twelve events.
    assert log.states().count() <= 5 + 3
    log.compact(everything=True)
    assert len(log.parts()) == 1 and log.states().count() == 5
    # A reader that planned before still finds its parts; a job that died before it marked them does no harm.
    assert as_set(early) == wanted
    for part in log.parts(merged=True):
        log._fs().delete(log._hadoop_path(part.path, state_log.MERGED), False)
    assert len(log.parts()) > 10 and as_set(store.runs()) == wanted
    log.compact(everything=True, grace_seconds=-60)
    assert log.parts(merged=True) == [] and as_set(store.runs()) == wanted


def test_only_named_streams_are_read(spark, store):
    log = store.logs["run_events"]
    log.append(run_states(some_events(spark)))
    of = spark.createDataFrame([("s1",)], "stream_id string")
    assert {r["stream_id"] for r in store.runs(of=of).collect()} == {"s1"}
    plan = store.runs(of=of)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan and "PushedFilters: [" in plan
    many = spark.range(700).select(F.format_string("%03x", "id").alias("stream_id"))
    assert len(state_log.buckets(many)) == 44
    none = spark.createDataFrame([(None,)], "stream_id string")
    assert state_log.buckets(none) is None


def alert(spark, run: str, score: float):
    return spark.sql(
        f"select 'a' as alert_id, 'k' as dedupe_key, '{run}' as run_id, 's' as stream_id, 'f' as row_fingerprint, "
        f"timestamp'2024-01-01' as observed_at, double({score}) as score, 'ensemble' as detector, null as explanation"
    )


def test_a_failed_run_does_not_replace_an_alert(spark, store):
    def run(name, status):
        store.record_runs(
            spark.createDataFrame([(name, "s")], "run_id string, stream_id string"), "detection", status, {"x": "y"}
        )

    log = store.logs["alert_versions"]
    run("one", "running")
    assert store.upsert_alerts(alert(spark, "one", 1.0), "b1").first()["inserted"]
    assert store.alerts().count() == 0
    run("one", "completed")
    log.compact(everything=True)
    run("two", "running")
    assert not store.upsert_alerts(alert(spark, "two", 2.0), "b2").first()["inserted"]
    log.compact(everything=True)
    assert [r["score"] for r in store.alerts().collect()] == [1.0]
    run("two", "failed")
    log.compact(everything=True)
    assert [r["score"] for r in store.alerts().collect()] == [1.0]
    run("two", "completed")
    log.compact(everything=True)
    row = store.alerts().first()
    assert row["score"] == 2.0 and log.states().count() == 1
    assert row["created_at"] < log.states().first()["event_at"]


def observed(spark, stream: str, n: int):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id"))
    return spark.range(n).select(
        F.sha2(F.lit(stream), 256).alias("stream_id"), F.lit("r").alias("run_id"), at.alias("observed_at"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("payload"),
        F.concat_ws("-", F.lit(stream), F.col("id").cast("string")).alias("row_fingerprint"),
    )


def test_deletion_is_a_record_and_purge_takes_the_rows_off_the_disk(spark, store):
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    store.upsert_streams(names, "csv_batch", {})
    store.append_observations(observed(spark, "a", 5).unionByName(observed(spark, "b", 3)), "both")
    store.append_observations(observed(spark, "a", 9), "rest")
    assert store.observations().count() == 12
    store.delete_stream("absent")
    store.delete_stream("a")
    assert [r["name"] for r in store.streams().collect()] == ["b"]
    assert store.observations().count() == 3
    assert store._stored("observations").count() == 12
    store.purge(grace_seconds=-60)
    store.purge(grace_seconds=-60)
    assert store._stored("observations").count() == 3
    assert not store._exists(f"{store.path('observations')}/batch_id=rest")
    assert store.logs["streams"].states().count() == 1
    # Stored anew: the same keys count as new, in a batch of the same name or another.
    store.upsert_streams(names.where("name = 'a'"), "csv_batch", {})
    assert store.append_observations(observed(spark, "a", 9), "rest").count() == 9
    assert store.observations().count() == 12 and store.streams().count() == 2


def test_a_store_without_anything(store):
    store.purge()
    assert store.runs().count() == store.alerts().count() == store.streams().count() == 0
    assert store.observations().count() == store.scores().count() == 0


def test_purge_spreads_a_large_batch_over_tasks(spark, store):
    """The rows kept of one batch are rewritten by the tasks that hold them, not gathered in one."""
    names = ["a", "b", "c", "d", "e", "f", "g", "h"]
    # Partitions stay as they are, as those of a large batch would.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert_streams(spark.createDataFrame([(n,) for n in names], "name string"), "csv_batch", {})
        store.append_observations(_union([observed(spark, name, 50) for name in names]), "all")
        store.delete_stream("a")
        store.purge(grace_seconds=-60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = store._stored("observations")
    assert stored.count() == store.observations().count() == 350
    assert stored.select(F.input_file_name()).distinct().count() > 1


def _union(frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
