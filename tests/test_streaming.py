from __future__ import annotations

import json

import pytest
from tests.data import sample_rows

from tidewatch.config import DEFAULT_DETECT, MessageSourceConfig
from tidewatch.streaming.consume import consume, consume_batch
from tidewatch.tables.store import TableStore

SCHEMA = "value string, topic string, partition int, offset bigint"
CONFIG = MessageSourceConfig("live", topic="t")


def messages(spark, start: int, count: int):
    rows = sample_rows(start + count, 3)[start:]
    bodies = [json.dumps({"timestamp": t.isoformat() + "Z", "value": v, "source": "test"}) for t, v in rows]
    return spark.createDataFrame([(b, "t", 0, start + i) for i, b in enumerate(bodies)], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


def read(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_batches_are_stored_and_scored(spark, store, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    results, alerts = [], []
    for start in (0, 30):
        messages(spark, start, 30).coalesce(1).write.mode("append").parquet(source)
        consume(
            store, read(spark, source), CONFIG, checkpoint, DEFAULT_DETECT,
            on_result=lambda r: results.append(r.first()), on_alerts=lambda a: alerts.append(a.count()),
        ).awaitTermination()
    assert [r["records_written"] for r in results] == [30, 30]
    assert store.observations().count() == 60 and len(alerts) == 2
    # Detection scores the batch that just came in, not the whole stream.
    runs = [r for r in store.runs().collect() if r["run_type"] == "detection"]
    assert [r["metadata"]["observations_scored"] for r in runs] == ["30", "30"]
    about = [r for r in store.runs().collect() if r["run_type"] == "ingestion"][0]["metadata"]
    assert json.loads(about["kafka_offsets"])[0]["messages"] == 30


def test_a_replayed_batch_changes_nothing(spark, store):
    first = consume_batch(store, messages(spark, 0, 20), CONFIG).first()
    again = consume_batch(store, messages(spark, 0, 20), CONFIG).first()
    assert not first["skipped"] and again["skipped"]
    assert again["run_id"] == first["run_id"]
    assert store.observations().count() == 20


def test_an_empty_batch_leaves_no_run(spark, store):
    assert consume_batch(store, spark.createDataFrame([], SCHEMA), CONFIG) is None
    assert store.runs().count() == 0


def test_the_same_reading_twice(spark, store):
    one = messages(spark, 0, 12)
    resent = one.selectExpr("value", "topic", "partition", "offset + 100 as offset")
    both = one.unionByName(resent)
    assert consume_batch(store, both, CONFIG).first()["records_written"] == 24
    other = MessageSourceConfig("other", topic="t")
    kept = consume_batch(store, both, other, dedupe_on=("observed_at", "value")).first()
    assert kept["records_written"] == 12


def test_bad_messages(spark, store):
    bad = messages(spark, 0, 12).unionByName(spark.createDataFrame([("oops", "t", 0, 99)], SCHEMA))
    with pytest.raises(Exception, match="at offset 99"):
        consume_batch(store, bad, CONFIG)
    rejected = []
    result = consume_batch(store, bad, CONFIG, on_invalid=lambda b: rejected.extend(b.collect()))
    assert result.first()["records_written"] == 12
    assert [r["offset"] for r in rejected] == [99]
