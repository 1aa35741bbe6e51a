"""The index of stored keys: nothing stored is missed, and what is read does not grow with the batches."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.tables import membership
from tidewatch.tables.store import TableStore

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def rows(spark, batch: int, keys: range, hours: int = 1):
    """Observations of one batch; all batches share the same hours unless told otherwise."""
    base = F.lit(START).cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(base) + F.col("id") * 1_000_000 + (hours - 1) * 3_600_000_000)
    return spark.range(keys.start, keys.stop).select(
        F.lit("s").alias("stream_id"), F.lit(f"run{batch}").alias("run_id"), at.alias("observed_at"),
        F.lit(1.0).alias("value"), F.lit("{}").alias("payload"),
        F.sha2(F.concat_ws("|", F.lit(str(batch)), F.col("id").cast("string")), 256).alias("row_fingerprint"),
    )


def thousand_batches(spark, store) -> None:
    """Stored by one job, as if by an earlier version without an index."""
    many = rows(spark, 0, range(5000))
    at = F.pmod(F.xxhash64("row_fingerprint"), F.lit(1000))
    many = many.withColumn("batch_id", F.format_string("b%04d", at))
    many.repartition("batch_id").write.partitionBy("batch_id").parquet(store.path("observations"))


def test_what_is_read_does_not_grow_with_the_batches(spark, store):
    thousand_batches(spark, store)
    before = store.read("observations")
    assert before.select("batch_id").distinct().count() > 950
    added = store.append_observations(rows(spark, 1, range(20)), "new1")
    assert added.count() == 20 and len(store.membership.files()) == 2
    # Keys no batch holds: of a thousand batches in the same hours, next to none is looked at.
    span = rows(spark, 2, range(20)).agg(F.min("observed_at"), F.max("observed_at")).first()
    assert len(store.membership.candidates(rows(spark, 2, range(20)), *span)) < 250
    # A stored row again: its batch is found, and only such batches are read.
    again = before.where("batch_id = 'b0007'").drop("batch_id").withColumn("run_id", F.lit("later"))
    count = again.count()
    assert count > 0 and store.append_observations(again, "new2").count() == 0
    found = store.membership.candidates(again, *again.agg(F.min("observed_at"), F.max("observed_at")).first())
    assert "b0007" in found
    read = store.read_batches("observations", found).inputFiles()
    assert {name.split("batch_id=")[1].split("/")[0] for name in read} == set(found)
    assert len(found) < 250
    # Other hours: nothing is looked at, whatever the keys.
    other = rows(spark, 3, range(20), hours=500)
    assert store.membership.candidates(other, *other.agg(F.min("observed_at"), F.max("observed_at")).first()) == []


def test_no_stored_key_is_missed(spark, store, monkeypatch):
    monkeypatch.setattr(membership, "MERGE_AT", 4)
    for batch in range(10):
        store.append_observations(rows(spark, batch, range(batch * 37, batch * 37 + 50 + batch)), f"b{batch}")
        assert len(store.membership.files()) <= 4
    for batch in range(10):
        mine = rows(spark, batch, range(batch * 37, batch * 37 + 50 + batch))
        span = mine.agg(F.min("observed_at"), F.max("observed_at")).first()
        assert f"b{batch}" in store.membership.candidates(mine, *span)
        assert store.append_observations(mine, f"again{batch}").count() == 0
    assert store.observations().count() == sum(50 + b for b in range(10))


def test_a_batch_written_again_and_an_empty_one(spark, store):
    assert store.append_observations(rows(spark, 1, range(0)), "none").count() == 0
    assert store.append_observations(rows(spark, 1, range(10)), "b").count() == 10
    assert store.append_observations(rows(spark, 1, range(10)), "b").count() == 10
    twice = rows(spark, 2, range(5)).union(rows(spark, 2, range(5)))
    assert store.append_observations(twice, "c").count() == 5
    assert store.observations().count() == 15


def test_rows_of_failed_runs_do_not_count_as_stored(spark, store):
    store.append_observations(rows(spark, 1, range(10)), "b")
    runs = spark.createDataFrame([("run1", "s")], "run_id string, stream_id string")
    store.record_runs(runs, "ingestion", "failed", {"error": "x"})
    later = rows(spark, 1, range(10)).withColumn("run_id", F.lit("run9"))
    assert store.append_observations(later, "c").count() == 10
