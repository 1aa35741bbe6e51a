from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from tests.data import write_csv

from tidewatch.config import (
    FileSourceConfig,
    LabelledSourceConfig,
    MessageSourceConfig,
    QuerySourceConfig,
    RetailSourceConfig,
    SourceConfig,
)
from tidewatch.functions.times import iso_utc, parse_iso
from tidewatch.operators.inject import retail_sample
from tidewatch.sources.labelled import label_by_windows, labelled_csv, labelled_source, load_anomaly_windows
from tidewatch.sources.messages import offset_ranges, parse_messages, split_messages
from tidewatch.sources.registry import build_source, register_source
from tidewatch.sources.timeseries import observations, split_invalid

UTC = "2024-01-01 00:00:00"


def test_csv_two_rows(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [("2024-01-01T00:00:00", 1.0), ("2024-01-01T00:01:00", 2.5)])
    rows = build_source(spark, FileSourceConfig("a", path=path)).orderBy("observed_at").collect()
    assert [r["value"] for r in rows] == [1.0, 2.5]
    assert rows[1]["observed_at"] == dt.datetime(2024, 1, 1, 0, 1)
    assert json.loads(rows[0]["payload"]) == {"value": 1.0}


def test_times_are_utc(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [("2024-01-01T02:00:00+02:00", 1.0), ("2024-01-01 00:00:00", 2.0)])
    rows = build_source(spark, FileSourceConfig("a", path=path)).collect()
    assert {r["observed_at"] for r in rows} == {dt.datetime(2024, 1, 1)}


@pytest.mark.parametrize("bad", ["not-a-number", "", "NaN"])
def test_bad_value_fails_the_load(spark, tmp_path, bad):
    path = write_csv(tmp_path / "a.csv", [(UTC, 1.0), (UTC, bad)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|null or NaN"):
        build_source(spark, FileSourceConfig("a", path=path)).count()
        build_source(spark, FileSourceConfig("a", path=path)).select("value").collect()


def test_bad_rows_can_be_set_aside(spark):
    rows = spark.createDataFrame([(UTC, "1.5"), (UTC, "x"), (None, "2"), (UTC, "NaN")], "t string, v string")
    good, bad = split_invalid(rows, "t", "v")
    assert [r["v"] for r in good.collect()] == [1.5]
    assert bad.count() == 3


def test_missing_columns(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [(UTC, 1.0)])
    with pytest.raises(ValueError, match="timestamp"):
        build_source(spark, FileSourceConfig("a", path=path, timestamp_column="when"))
    with pytest.raises(ValueError, match="value"):
        build_source(spark, FileSourceConfig("a", path=path, value_column="price"))
    with pytest.raises(ValueError, match="Quantity"):
        build_source(spark, RetailSourceConfig("a", path=path, timestamp_column="timestamp"))


def test_payload_choice_and_overrides(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, "x", None)], "t timestamp, value double, a string, b int")
    everything = observations(rows, "t", "value").first()["payload"]
    assert everything == '{"a":"x","b":null,"value":1.0}'
    some = observations(rows, "t", "value", ["a", "t", "absent"]).first()
    assert some["payload"] == '{"a":"x"}' and some["value"] == 1.0
    extra = {"a": F.lit("y"), "later": F.col("t")}
    over = json.loads(observations(rows, "t", "value", ["a"], extra).first()["payload"])
    assert over == {"a": "y", "later": "2024-01-01T00:00:00+00:00"}


def test_typed_csv_columns(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", [(UTC, 1.0, 7)], "timestamp,value,level")
    config = FileSourceConfig("a", path=path, schema="timestamp string, value double, level int")
    assert json.loads(build_source(spark, config).first()["payload"]) == {"level": 7, "value": 1.0}


def test_iso_text(spark):
    frame = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T01:00:00+01:00",), ("2024-01-01",), ("12345",), ("1704067200",), ("noon",)], "t string")
    parsed = [r[0] for r in frame.select(parse_iso(F.col("t"))).collect()]
    assert parsed == [dt.datetime(2024, 1, 1)] * 3 + [None] * 3
    stamps = spark.sql("select timestamp'2024-01-01 00:00:00.5' a, timestamp'2024-01-01 00:00:00' b")
    row = stamps.select(iso_utc(F.col("a")), iso_utc(F.col("b"))).first()
    assert tuple(row) == ("2024-01-01T00:00:00.500000+00:00", "2024-01-01T00:00:00+00:00")


def labels(tmp_path, content) -> str:
    path = tmp_path / "labels.json"
    path.write_text(content if isinstance(content, str) else json.dumps(content))
    return str(path)


WINDOW = [["2024-01-01 19:00:00", "2024-01-02 01:00:00"]]


@pytest.mark.parametrize("key", ["cpu", "realKnownCause/cpu.csv", "realKnownCause/cpu"])
def test_labelled_source(spark, tmp_path, key):
    data = [("2024-01-01 18:00:00", 40.0), ("2024-01-01 19:30:00", 90.0), ("2024-01-02 02:00:00", 41.0)]
    config = LabelledSourceConfig(
        "nab",
        path=write_csv(tmp_path / "a.csv", data),
        dataset_name="cpu",
        labels_path=labels(tmp_path, {key: WINDOW, "other": [["2024-01-01", "2025-01-01"]]}),
    )
    rows = build_source(spark, config).orderBy("observed_at").collect()
    payloads = [json.loads(r["payload"]) for r in rows]
    assert [p["label"] for p in payloads] == [0, 1, 0]
    assert {p["dataset"] for p in payloads} == {"cpu"}


def test_label_files(spark, tmp_path):
    assert load_anomaly_windows(spark, None, "cpu").count() == 0
    assert load_anomaly_windows(spark, str(tmp_path / "absent.json"), "cpu").count() == 0
    assert load_anomaly_windows(spark, labels(tmp_path, "[1, 2]"), "cpu").count() == 0
    assert load_anomaly_windows(spark, labels(tmp_path, {"x": WINDOW}), "cpu").count() == 0
    odd = {"cpu": [*WINDOW, ["2024-01-01"], "text", ["a", "b", "c"]], "realKnownCause/cpu": WINDOW * 3}
    assert load_anomaly_windows(spark, labels(tmp_path, odd), "cpu").count() == 1


def test_window_ends_are_inside_and_overlaps_count_once(spark):
    base = dt.datetime(2024, 1, 1, 23)
    times = [base + dt.timedelta(minutes=m) for m in range(0, 181, 15)]
    rows = spark.createDataFrame([("a", t) for t in times] + [("b", times[3])], "key string, t timestamp")
    windows = spark.createDataFrame(
        [("a", times[1], times[6]), ("a", times[4], times[8]), ("a", times[4], times[5]), ("a", times[9], times[2])],
        "key string, start timestamp, end timestamp",
    )
    out = label_by_windows(rows, windows, "t", ["key"]).collect()
    assert len(out) == len(times) + 1
    marked = {r["t"] for r in out if r["label"] == 1 and r["key"] == "a"}
    assert marked == set(times[1:9])
    assert [r["label"] for r in out if r["key"] == "b"] == [0]


def test_retail(spark, tmp_path):
    header = "InvoiceDate,Quantity,UnitPrice"
    data = [("2011-01-01 08:00:00", 2, 10), ("2011-01-01 09:00:00", 1, 4), ("2011-01-02 08:00:00", 5, 2)]
    path = write_csv(tmp_path / "r.csv", data, header)
    rows = build_source(spark, RetailSourceConfig("r", path=path)).orderBy("observed_at").collect()
    assert [r["value"] for r in rows] == [24.0, 10.0]
    assert json.loads(rows[0]["payload"]) == {"aggregate": "daily_revenue", "invoice_lines": 2, "value": 24.0}
    quantity = RetailSourceConfig("r", path=path, aggregate="daily_quantity")
    assert [r["value"] for r in build_source(spark, quantity).orderBy("observed_at").collect()] == [3.0, 5.0]


def test_retail_sample(spark):
    lines = retail_sample(spark.range(120).withColumnRenamed("id", "day"))
    assert lines.count() == sum(20 + (d % 7) * 3 for d in range(120))
    first = lines.where("InvoiceDate = timestamp'2011-04-01 00:00:00'").first()
    assert (first["Quantity"], first["UnitPrice"], first["StockCode"]) == (25.0, 2.5, "S1000")


def test_sql_source(spark):
    spark.range(3).selectExpr(
        "timestamp_seconds(id * 3600) as observed_at", "cast(id as float) as value", "date'2024-01-01' as day"
    ).createOrReplaceTempView("readings")
    rows = build_source(spark, QuerySourceConfig("q", query="select * from readings;")).collect()
    assert sorted(r["value"] for r in rows) == [0.0, 1.0, 2.0]
    assert json.loads(rows[0]["payload"])["day"] == "2024-01-01"
    with pytest.raises(ValueError, match="value"):
        build_source(spark, QuerySourceConfig("q", query="select observed_at from readings"))


def raw(spark, *bodies):
    rows = [(body, "t", 0, i + 12) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, "value string, topic string, partition int, offset bigint")


GOOD = '{"timestamp": "2024-01-01T00:00:00+00:00", "value": 42.5, "source": "demo", "kafka": 1, "deep": {"b": [1], "a": 2}}'


def test_message(spark):
    row = parse_messages(raw(spark, GOOD)).first()
    assert row["observed_at"] == dt.datetime(2024, 1, 1) and row["value"] == 42.5
    payload = json.loads(row["payload"])
    assert payload["kafka"] == {"offset": 12, "partition": 0, "topic": "t"}
    assert payload["source"] == "demo" and payload["value"] == 42.5
    assert row["payload"].index('"a"') < row["payload"].index('"b"')


@pytest.mark.parametrize(
    "body",
    ['{"value": 1}', '{"timestamp": "2024-01-01"}', '{"timestamp": 1704067200, "value": 1}',
     '{"timestamp": "2024-01-01", "value": "abc"}', "[1]", "nonsense", '"text"'],
)
def test_bad_messages(spark, body):
    with pytest.raises(Exception, match="at offset 13"):
        parse_messages(raw(spark, GOOD, body)).collect()
    good, bad = split_messages(raw(spark, GOOD, body))
    assert good.count() == 1
    assert [(r["offset"], bool(r["problem"])) for r in bad.collect()] == [(13, True)]


def test_numbers_in_other_clothes(spark):
    text = '{"timestamp": "2024-01-01T00:00:00Z", "value": "42"}'
    truth = '{"timestamp": "2024-01-01T00:00:00", "value": true}'
    assert [r["value"] for r in parse_messages(raw(spark, text, truth)).collect()] == [42.0, 1.0]


def test_own_fields_and_offsets(spark):
    body = '{"when": "2024-01-01", "reading": 3, "value": "kept"}'
    row = parse_messages(raw(spark, body), "when", "reading").first()
    assert json.loads(row["payload"])["reading"] == 3.0
    assert json.loads(row["payload"])["value"] == "kept"
    ranges = offset_ranges(raw(spark, body, body)).first()
    assert (ranges["first_offset"], ranges["last_offset"], ranges["messages"]) == (12, 13, 2)


def test_labelled_csv_keeps_file_order_of_ties(spark, tmp_path):
    data = [("2024-01-01 00:01:00", 5.0, 0), (UTC, 1.0, 1), (UTC, 2.0, 0), (UTC, 3.0, 2)]
    path = write_csv(tmp_path / "l.csv", data, "timestamp,value,label")
    rows = labelled_csv(spark, path).orderBy("idx").collect()
    assert [(r["idx"], r["value"], r["label"]) for r in rows] == [
        (0, 1.0, True), (1, 2.0, False), (2, 3.0, True), (3, 5.0, False)
    ]


def test_labelled_files_keep_the_order_of_their_names(spark, tmp_path):
    # The larger file is read first, whatever its name, and in many blocks.
    folder = tmp_path / "many"
    folder.mkdir()
    write_csv(folder / "a.csv", [(UTC, 1.0, 0)], "timestamp,value,label")
    write_csv(folder / "b.csv", [(UTC, float(i), 1) for i in range(2, 400)], "timestamp,value,label")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = labelled_csv(spark, str(folder)).orderBy("idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in rows] == [float(i) for i in range(1, 400)]


def test_own_source_and_unknown_source(spark):
    class Ticks(SourceConfig):
        source_type = "ticks"

    with pytest.raises(ValueError, match="Unsupported"):
        build_source(spark, Ticks("t"))
    register_source(
        Ticks,
        lambda s, c: s.range(2).selectExpr(
            "timestamp_seconds(id) as observed_at", "cast(id as double) as value", "'{}' as payload"
        ),
    )
    assert build_source(spark, Ticks("t")).count() == 2


def test_config_checks():
    for make in (
        lambda: FileSourceConfig("", path="x"),
        lambda: FileSourceConfig("a"),
        lambda: FileSourceConfig("a", path="x", format="orc"),
        lambda: RetailSourceConfig("a", path="x", aggregate="weekly"),
        lambda: QuerySourceConfig("a", query=" "),
        lambda: MessageSourceConfig("a"),
        lambda: MessageSourceConfig("a", topic="t", auto_offset_reset="middle"),
    ):
        with pytest.raises(ValueError):
            make()


def test_labelled_points_are_counted_in_the_same_pass(spark, tmp_path):
    path = tmp_path / "cpu.csv"
    path.write_text("timestamp,value\n2024-01-01 00:00:00,1\n2024-01-01 01:00:00,2\n2024-01-01 02:00:00,3\n")
    listed = {"cpu": [["2024-01-01 00:30:00", "2024-01-01 01:00:00"]]}
    seen = Observation()
    read = labelled_source(spark, str(path), "cpu", labels_path=labels(tmp_path, listed), seen=seen)
    assert read.collect() and seen.get == {"points": 3, "labelled_points": 1}
    unlabelled = Observation()
    labelled_source(spark, str(path), "cpu", seen=unlabelled).collect()
    assert unlabelled.get == {"points": 3, "labelled_points": 0}
