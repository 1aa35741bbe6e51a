"""Every operator as a query over the shared test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.config import (
    BenchmarkConfig,
    DetectConfig,
    DetectorConfig,
    FileSourceConfig,
    MessageSourceConfig,
    QuerySourceConfig,
    RetailSourceConfig,
)
from tidewatch.functions.hashing import row_fingerprint, stream_id
from tidewatch.functions.scoring import min_max
from tidewatch.functions.times import coerce_utc, iso_utc
from tidewatch.operators.ensemble import Scored, score_ensemble, scores_long, with_score_bounds
from tidewatch.operators.forest import ForestDetector
from tidewatch.operators.inject import (
    baseline_value,
    inject,
    labelled_records,
    retail_sample,
    sample_series,
    sample_value,
    select_indices,
)
from tidewatch.operators.mad import MadDetector
from tidewatch.operators.metrics import (
    classification_counts,
    false_positives_per_hour,
    precision_recall_f1,
    set_counts,
)
from tidewatch.operators.order_stats import order_statistics, percentile_rank, ranked
from tidewatch.operators.split import (
    Series,
    fit_split,
    fit_splits,
    rank_targets,
    series_sizes,
    too_short,
    whole_series,
)
from tidewatch.plans import reports
from tidewatch.plans.detect import detect, latest_ingestion_runs
from tidewatch.plans.evaluate import evaluate_series, flags_long
from tidewatch.plans.explain import (
    attribute_forest,
    explain_alerts,
    explain_mad,
    forest_contributions,
    mad_contributions,
    primary_detector,
    weighted_contributions,
)
from tidewatch.plans.ingest import batch_content_hash, content_hashes, ingest, ingest_records
from tidewatch.session import configure, scratch_root, settle
from tidewatch.sources.labelled import label_by_windows, labelled_csv, labelled_source
from tidewatch.sources.messages import offset_ranges, parse_messages, split_messages
from tidewatch.sources.query import hourly_count, hourly_mean, replay
from tidewatch.sources.registry import build_source
from tidewatch.sources.retail import daily_quantity, daily_revenue
from tidewatch.sources.timeseries import (
    conform_timeseries,
    observations,
    split_invalid,
    validate_not_null,
)
from tidewatch.streaming.consume import consume
from tidewatch.tables import store as tables
from tidewatch.tables.publish import publish_json
from tidewatch.tables.store import TableStore

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its function name; it runs in a configured session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Inputs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as series: one per event type, with ``value`` and ``k`` as features."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stream"),
        "event_id",
        coerce_utc(F.col("ts")).alias("ts"),
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "props",
    )


def split_events(spark: SparkSession, sf_dir: str) -> Series:
    return fit_split(events(spark, sf_dir).drop("props"), ["stream"], ["ts", "event_id"])


TWO_MADS = (MadDetector("mad_value", "value"), MadDetector("mad_k", "k"))
TWO_WEIGHTS = (0.6, 0.4)


def ensemble(spark: SparkSession, sf_dir: str, percentile: float = 95.0) -> tuple[Series, Scored]:
    series = split_events(spark, sf_dir)
    return series, score_ensemble(series, TWO_MADS, TWO_WEIGHTS, percentile)


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as stored observations, without writing them to a store."""
    rows = observations(events(spark, sf_dir), "ts", "value", ["value", "k"], carry=["stream", "event_id"])
    sid = stream_id(F.col("stream"))
    return rows.withColumn("stream_id", sid).withColumn(
        "row_fingerprint", row_fingerprint(sid, F.col("observed_at"), F.col("payload"))
    )


def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return names.select(stream_id(F.col("name")).alias("stream_id"), "name")


def event_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of the two-feature ensemble over the events, in the shape the store has."""
    series, scored = ensemble(spark, sf_dir)
    explained = explain_alerts(
        scored.rows.where("is_anomaly"), series, TWO_MADS, scored.models, TWO_WEIGHTS, "value", "ts"
    )
    return explained.select(
        F.col("event_id").cast("string").alias("alert_id"),
        stream_id(F.col("stream")).alias("stream_id"),
        F.col("event_id").cast("string").alias("row_fingerprint"),
        F.col("ts").alias("observed_at"),
        F.col("stream").alias("run_id"),
        F.col("ensemble").alias("score"),
        F.lit("ensemble").alias("detector"),
        "explanation",
        F.col("ts").alias("created_at"),
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_events(spark, sf_dir).select(
        "stream_id",
        F.col("event_id").cast("string").alias("row_fingerprint"),
        "observed_at",
        "payload",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as JSON messages, spread over four partitions by user."""
    body = F.struct(
        iso_utc(F.col("ts")).alias("timestamp"),
        F.col("value"),
        F.col("stream").alias("source"),
        F.from_json("props", "struct<k:bigint>").alias("props"),
    )
    return events(spark, sf_dir).select(
        F.to_json(body).alias("value"),
        F.lit("observations").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        "stream",
    )


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/catalogue/{name}-{uuid.uuid4().hex}"


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events from the orders: each starts on its date and ends a day later unless open."""
    orders = table(spark, sf_dir, "orders")
    started = coerce_utc(F.col("o_orderdate"))
    run = F.col("o_orderkey").cast("string").alias("run_id")
    stream = F.col("o_custkey").cast("string").alias("stream_id")
    amount = F.floor("o_totalprice").cast("string")
    kind = F.when(F.col("o_orderkey") % 3 == 0, F.lit("detection")).otherwise(F.lit("ingestion"))
    running = orders.select(
        run,
        stream,
        kind.alias("run_type"),
        F.lit("running").alias("status"),
        started.alias("event_at"),
        F.create_map(
            F.lit("content_hash"), F.md5(F.col("o_orderkey").cast("string")),
            F.lit("batch_id"), F.col("o_orderpriority"),
            F.lit("row_count"), F.lit("0"),
        ).alias("metadata"),
    )
    last = F.when(F.col("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("failed"))
    ended = orders.where(F.col("o_orderstatus") != "O").select(
        run,
        stream,
        kind.alias("run_type"),
        last.alias("status"),
        (started + F.expr("interval 1 day")).alias("event_at"),
        F.create_map(F.lit("row_count"), amount, F.lit("alerts_created"), F.lit("2")).alias("metadata"),
    )
    return running.unionByName(ended)


# Sources


@query
def conform_events(spark, sf_dir):
    rows = conform_timeseries(table(spark, sf_dir, "events"), "ts", "value")
    return validate_not_null(rows, "ts", "value").select(
        "event_id", F.col("ts").alias("observed_at"), "value"
    )


@query
def split_invalid_rows(spark, sf_dir):
    """Purchases carry their value as text with a currency, which does not parse."""
    bad = F.when(F.col("event_type") == "purchase", F.concat(F.col("value").cast("string"), F.lit(" EUR")))
    rows = table(spark, sf_dir, "events").withColumn(
        "value", F.coalesce(bad, F.col("value").cast("string"))
    )
    good, rejected = split_invalid(rows, "ts", "value")
    return good.select("event_id", F.lit(True).alias("accepted"), "value").unionByName(
        rejected.select("event_id", F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("value"))
    )


@query
def csv_source(spark, sf_dir):
    path = scratch(spark, "events-csv")
    table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value").write.options(
        header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ).csv(path)
    config = FileSourceConfig("events", path=path, timestamp_column="ts", value_column="value")
    return build_source(spark, config).select(
        F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("payload", "$.event_type").alias("event_type"),
        "observed_at",
        "value",
    )


@query
def labelled_files(spark, sf_dir):
    """Events known by hour only, in several label files whose names follow their ids: ties keep that order."""
    path = scratch(spark, "labelled-csv")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.date_trunc("hour", "ts").alias("timestamp"),
        "value",
        (F.col("event_id") % 7 == 0).cast("int").alias("label"),
    )
    # Part files are named by the range of ids they hold.
    ordered = rows.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id")
    ordered.write.options(header=True, timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss").csv(path)
    return labelled_csv(spark, path)


def _labelled_series(spark: SparkSession, sf_dir: str, seen: Observation | None = None) -> DataFrame:
    """The events as a CSV series, and a label file with an hour from the first error of each day on."""
    path, labels = scratch(spark, "series-csv"), scratch(spark, "windows-json")
    rows = events(spark, sf_dir).select("event_id", F.col("ts").cast("string").alias("timestamp"), "value")
    rows.write.option("header", True).csv(path)
    errors = events(spark, sf_dir).where("stream = 'error'").groupBy(F.to_date("ts")).agg(F.min("ts").alias("ts"))
    ends = F.array(*[(F.col("ts") + F.expr(f"interval {h} hours")).cast("string") for h in (0, 1)])
    # Besides the windows, one per day: an entry that is no pair, and another data set's windows.
    windows = F.array_append(F.sort_array(F.collect_list(ends)), F.array(F.lit("2024-01-15 00:00:00")))
    listed = F.create_map(
        F.lit("realKnownCause/events.csv"), windows,
        F.lit("other"), F.array(F.array(F.lit("1990-01-01"), F.lit("2100-01-01"))),
    )
    errors.agg(F.to_json(listed)).write.text(labels)
    return labelled_source(spark, path, "events", labels_path=labels, seen=seen)


@query
def labelled_series(spark, sf_dir):
    """Rows of a CSV series with the labels of a label file."""
    read = _labelled_series(spark, sf_dir)
    field = lambda name, kind: F.get_json_object("payload", f"$.{name}").cast(kind).alias(name)
    return read.select(
        field("event_id", "bigint"), "observed_at", "value", field("dataset", "string"), field("label", "int")
    )


@query
def labelled_points(spark, sf_dir):
    """Points and labelled points, counted by the job that stores the series, next to what it stored."""
    seen = Observation()
    stored = settle(_labelled_series(spark, sf_dir, seen))
    points, labelled = seen.get["points"], seen.get["labelled_points"]
    return stored.agg(F.count(F.lit(1)).alias("stored")).select(
        "stored", F.lit(points).cast("bigint").alias("points"), F.lit(labelled).cast("bigint").alias("labelled_points")
    )


@query
def parquet_source(spark, sf_dir):
    config = FileSourceConfig(
        "events",
        path=f"{sf_dir}/events.parquet",
        timestamp_column="ts",
        value_column="value",
        format="parquet",
        include_columns=("event_id", "event_type", "ts", "absent"),
    )
    return build_source(spark, config).select(
        F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"),
        F.get_json_object("payload", "$.event_type").alias("event_type"),
        F.get_json_object("payload", "$.value").alias("payload_value"),
        "observed_at",
        "value",
    )


@query
def payload_fields(spark, sf_dir):
    """All columns, a constant, a derived key and a timestamp as ISO text in the payload."""
    rows = events(spark, sf_dir).withColumn("seen", F.col("ts"))
    extra = {"dataset": F.lit("events"), "high": (F.col("value") > 50).cast("int")}
    out = observations(rows, "ts", "value", None, extra)

    def key(name: str, kind: str = "string") -> Column:
        return F.get_json_object("payload", f"$.{name}").cast(kind).alias(name)

    return out.select(
        key("event_id", "bigint"), key("stream"), key("user_id", "bigint"), key("k", "double"),
        key("dataset"), key("high", "int"), key("seen"), "value",
    )


@query
def label_windows(spark, sf_dir):
    """Events of a user within six hours after one of the user's errors."""
    rows = events(spark, sf_dir)
    errors = rows.where(F.col("stream") == "error").select(
        "user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 6 hours")).alias("end")
    )
    return label_by_windows(rows.select("event_id", "user_id", "ts"), errors, "ts", ["user_id"]).select(
        "event_id", "label"
    )


@query
def daily_revenue_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    daily = daily_revenue(lines, "l_shipdate", "l_quantity", "l_extendedprice")
    return daily.withColumn("value", F.round("value", 2))


@query
def daily_quantity_lines(spark, sf_dir):
    return daily_quantity(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity")


@query
def retail_csv(spark, sf_dir):
    path = scratch(spark, "lines-csv")
    table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice").write.option(
        "header", True
    ).csv(path)
    config = RetailSourceConfig(
        "lines",
        path=path,
        timestamp_column="l_shipdate",
        quantity_column="l_quantity",
        price_column="l_extendedprice",
        aggregate="daily_quantity",
    )
    return build_source(spark, config).select(
        "observed_at",
        "value",
        F.get_json_object("payload", "$.invoice_lines").cast("bigint").alias("invoice_lines"),
        F.get_json_object("payload", "$.aggregate").alias("aggregate"),
    )


@query
def sql_snapshot(spark, sf_dir):
    """Daily order totals per priority through the SQL source."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("tidewatch_orders")
    config = QuerySourceConfig(
        "orders",
        query="""
            SELECT date_trunc('day', o_orderdate) AS observed_at, o_orderpriority AS priority,
                   sum(o_totalprice) AS value
            FROM tidewatch_orders GROUP BY 1, 2
        """,
    )
    return build_source(spark, config).select(
        "observed_at",
        F.get_json_object("payload", "$.priority").alias("priority"),
        F.round("value", 2).alias("value"),
    )


@query
def hourly_event_count(spark, sf_dir):
    return hourly_count(table(spark, sf_dir, "events"), "ts")


@query
def hourly_event_mean(spark, sf_dir):
    hourly = hourly_mean(table(spark, sf_dir, "events"), "ts", "value")
    return hourly.withColumn("value", F.round("value", 6))


@query
def replay_values(spark, sf_dir):
    return replay(stored_events(spark, sf_dir), event_streams(spark, sf_dir))


@query
def json_extract_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


@query
def message_parse(spark, sf_dir):
    parsed = parse_messages(messages(spark, sf_dir))
    return parsed.select(
        "offset",
        "observed_at",
        "value",
        F.get_json_object("payload", "$.source").alias("source"),
        F.get_json_object("payload", "$.props.k").cast("bigint").alias("k"),
        F.get_json_object("payload", "$.kafka.partition").cast("int").alias("kafka_partition"),
        F.get_json_object("payload", "$.kafka.offset").cast("bigint").alias("kafka_offset"),
    )


@query
def message_quarantine(spark, sf_dir):
    """One way to be malformed per event type; views are fine."""
    body = F.col("value")
    broken = (
        F.when(F.col("stream") == "click", F.regexp_replace(body, r'"timestamp":"[^"]*"', '"timestamp":1704067200'))
        .when(F.col("stream") == "error", F.regexp_replace(body, r'"value":', '"reading":'))
        .when(F.col("stream") == "purchase", F.concat(F.lit("["), body, F.lit("]")))
        .when(F.col("stream") == "signup", F.regexp_replace(body, r'"value":[^,]*', '"value":"n/a"'))
        .otherwise(body)
    )
    good, bad = split_messages(messages(spark, sf_dir).withColumn("value", broken))
    return good.select("offset", F.lit(None).cast("string").alias("problem")).unionByName(
        bad.select("offset", "problem")
    )


@query
def message_offsets(spark, sf_dir):
    return offset_ranges(messages(spark, sf_dir))


@query
def messages_out(spark, sf_dir):
    out = publish_json(events(spark, sf_dir), "ts", "value", "events")
    return out.select(
        F.get_json_object("value", "$.ts").alias("ts"),
        F.get_json_object("value", "$.value").cast("double").alias("reading"),
        F.get_json_object("value", "$.source").alias("source"),
    )


# Fingerprints and stored tables


@query
def row_fingerprints(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select(
        "event_id",
        row_fingerprint(F.col("stream"), F.col("ts"), F.col("props")).alias("row_fingerprint"),
    )


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("stream").alias("stream_id"),
        row_fingerprint(F.col("stream"), F.col("ts"), F.col("props")).alias("row_fingerprint"),
        F.lit("observations").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
    )


@query
def content_hash(spark, sf_dir):
    return content_hashes(_printed(spark, sf_dir))


@query
def batch_hash(spark, sf_dir):
    return batch_content_hash(_printed(spark, sf_dir))


@query
def backfill_md5(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "event_id",
        F.col("stream").alias("stream_id"),
        F.col("ts").alias("observed_at"),
        F.col("props").alias("payload"),
        F.lit(None).cast("string").alias("row_fingerprint"),
    )
    return tables.backfill_fingerprints(rows).select("event_id", "row_fingerprint")


def _hourly_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events known only by hour and rounded value, so that many share a fingerprint."""
    hour = F.date_trunc("hour", F.col("ts"))
    rows = events(spark, sf_dir).select(
        F.col("stream").alias("stream_id"),
        hour.alias("observed_at"),
        F.floor("value").cast("string").alias("payload"),
        "ts",
    )
    return rows.withColumn(
        "row_fingerprint", row_fingerprint(F.col("stream_id"), F.col("observed_at"), F.col("payload"))
    )


@query
def append_dedupe(spark, sf_dir):
    """Two runs with shared rows: the first run keeps what both have; stored keys are found by index."""
    rows = _hourly_keys(spark, sf_dir).withColumn("value", F.lit(None).cast("double"))
    middle = F.lit("2024-01-15 12:30:00").cast("timestamp")
    columns = ["stream_id", "observed_at", "value", "payload", "row_fingerprint"]
    first = rows.where(F.col("ts") < middle).select(*columns, F.lit("first").alias("run_id"))
    second = rows.where(F.col("ts") >= middle - F.expr("interval 6 hours")).select(
        *columns, F.lit("second").alias("run_id")
    )
    store = TableStore(spark, scratch(spark, "store"))
    store.append_observations(first, "first")
    store.append_observations(second, "second")
    return store.observations().select("stream_id", "row_fingerprint", "run_id")


@query
def duplicate_rows(spark, sf_dir):
    return tables.duplicate_fingerprints(_hourly_keys(spark, sf_dir))


@query
def runs_current(spark, sf_dir):
    runs = tables.latest_runs(order_runs(spark, sf_dir))
    return runs.select(
        "run_id", "stream_id", "run_type", "status", "started_at", "finished_at",
        F.col("metadata")["row_count"].cast("bigint").alias("row_count"),
        F.col("metadata")["content_hash"].alias("content_hash"),
    )


@query
def runs_compacted(spark, sf_dir):
    """The same runs kept as states: starts are compacted, ends are in the tail, then both are."""
    events = order_runs(spark, sf_dir)
    store = TableStore(spark, scratch(spark, "store"))
    log = store.logs["run_events"]
    log.append(tables.run_states(events.where("status = 'running'")))
    log.compact(everything=True)
    log.append(tables.run_states(events.where("status <> 'running'")))
    tail = settle(store.runs().where("run_type = 'detection'"))
    log.compact(everything=True)
    return tail.unionByName(store.runs().where("run_type <> 'detection'")).select(
        "run_id", "stream_id", "run_type", "status", "started_at", "finished_at",
        F.col("metadata")["row_count"].cast("bigint").alias("row_count"),
        F.col("metadata")["content_hash"].alias("content_hash"),
    )


@query
def latest_run(spark, sf_dir):
    return latest_ingestion_runs(tables.latest_runs(order_runs(spark, sf_dir)))


@query
def runs_newest(spark, sf_dir):
    """The newest runs of the customer with the most orders."""
    orders = table(spark, sf_dir, "orders")
    busiest = (
        orders.groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "o_custkey")
        .first()
    )
    runs = tables.latest_runs(order_runs(spark, sf_dir))
    listed = reports.list_runs(runs, str(busiest["o_custkey"]), 20).drop("metadata")
    return listed.fillna(-1, ["observations_scored", "alerts_created"])


@query
def streams_current(spark, sf_dir):
    """Every order re-configures its customer's stream; the newest settings count."""
    versions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("stream_id"),
        F.col("o_custkey").cast("string").alias("name"),
        F.lit("csv_batch").alias("source_type"),
        F.col("o_orderpriority").alias("config"),
        (coerce_utc(F.col("o_orderdate")) + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias(
            "event_at"
        ),
    )
    return tables.latest_streams(versions)


@query
def ingest_counts(spark, sf_dir):
    """Ingest the events twice, each event type as a stream; the second time is skipped."""
    store = TableStore(spark, scratch(spark, "store"))
    records = stored_events(spark, sf_dir).select(
        F.col("stream").alias("stream_name"), "observed_at", "value", "payload"
    )
    once = settle(ingest_records(store, records, "parquet", {"table": "events"}))
    again = ingest_records(store, records, "parquet", {"table": "events"})
    columns = ["stream_name", "records_read", "records_written", "records_duplicate", "skipped"]
    return once.select(*columns).unionByName(again.select(*columns))


@query
def ingest_file(spark, sf_dir):
    """Ingest the events file as one stream and count what is stored."""
    store = TableStore(spark, scratch(spark, "store"))
    config = FileSourceConfig(
        "events", path=f"{sf_dir}/events.parquet", timestamp_column="ts", value_column="value",
        format="parquet",
    )
    ingest(store, config)
    return reports.count_observations(store.observations()).select("observations")


@query
def stream_deletion(spark, sf_dir):
    """One stream is deleted, its rows are purged, and the later half of it is stored anew."""
    store = TableStore(spark, scratch(spark, "store"))
    records = stored_events(spark, sf_dir).select(
        F.col("stream").alias("stream_name"), "observed_at", "value", "payload"
    )
    ingest_records(store, records, "parquet", {"table": "events"})
    gone = records.agg(F.min("stream_name")).first()[0]
    store.delete_stream(gone)
    left = settle(reports.count_observations(store.observations(), "stream_id"))
    store.purge(grace_seconds=0)
    later = (F.col("stream_name") == gone) & (F.col("observed_at") >= F.lit("2024-01-15 12:30:00"))
    ingest_records(store, records.where(later), "parquet", {"table": "events"})
    counts = reports.count_observations(store.observations(), "stream_id")
    before = left.withColumnRenamed("observations", "after_deletion")
    return store.streams().join(counts, "stream_id").join(before, "stream_id", "left").select(
        "name", "observations", F.coalesce("after_deletion", F.lit(0)).alias("after_deletion")
    )


# Detection


@query
def fit_window(spark, sf_dir):
    return split_events(spark, sf_dir).rows.select("event_id", "is_fit")


@query
def series_ranks(spark, sf_dir):
    return ranked(events(spark, sf_dir), ["stream"], ["ts", "event_id"]).select("event_id", "rank", "n")


@query
def short_series(spark, sf_dir):
    """Customers with too few orders to detect anything in."""
    sizes = series_sizes(table(spark, sf_dir, "orders"), ["o_custkey"])
    return too_short(sizes)


@query
def floor_percentile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    sizes = settle(series_sizes(orders, ["o_orderpriority"]))
    targets = rank_targets(sizes, ["o_orderpriority"], {"p95": percentile_rank(F.col("n"), 95.0)})
    found = order_statistics(orders, ["o_orderpriority"], ["o_totalprice"], targets)
    return found.select("o_orderpriority", F.col("o_totalprice").alias("p95"))


@query
def feature_values(spark, sf_dir):
    from tidewatch.plans.detect import feature_rows

    stored = stored_events(spark, sf_dir).withColumn("run_id", F.lit("run"))
    return feature_rows(stored, ["value", "k"]).select("row_fingerprint", "observed_at", "value", "k")


@query
def mad_params(spark, sf_dir):
    model = TWO_MADS[0].fit(split_events(spark, sf_dir))
    return model.select("stream", *[F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")])


@query
def mad_flags(spark, sf_dir):
    """Robust z-score and flag of every event."""
    series = split_events(spark, sf_dir)
    detector = TWO_MADS[0]
    scored, _ = detector.fit_and_score(series)
    return scored.select(
        "stream",
        "event_id",
        F.round("score__mad_value", 6).alias("score"),
        F.col("flag__mad_value").alias("is_anomaly"),
    )


@query
def mad_by_user(spark, sf_dir):
    """Many short series: one per user."""
    rows = events(spark, sf_dir).select("user_id", "event_id", "ts", "value")
    series = fit_split(rows, ["user_id"], ["ts", "event_id"])
    detector = MadDetector("mad", "value")
    scored, _ = detector.fit_and_score(series)
    return scored.select(
        "user_id", "event_id", F.round("score__mad", 6).alias("score"), F.col("flag__mad").alias("is_anomaly")
    )


@query
def mad_lineitem(spark, sf_dir):
    """Unusual prices per ship status over the largest table; the whole series is the fit window."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    keys = ["l_returnflag", "l_linestatus"]
    model = MadDetector("mad", "l_extendedprice").fit(whole_series(rows, keys))
    return model.select(*keys, *[F.round(c, 6).alias(c) for c in ("median", "mad", "threshold")])


@query
def min_max_scores(spark, sf_dir):
    """Fit bounds of a score, and the score scaled to them."""
    series = split_events(spark, sf_dir)
    detector = TWO_MADS[0]
    scored, _ = detector.fit_and_score(series)
    bounded = with_score_bounds(series.with_rows(scored), ["mad_value"])
    scaled = min_max(F.col("score__mad_value"), F.col("low__mad_value"), F.col("high__mad_value"))
    return bounded.rows.select("event_id", F.round(scaled, 6).alias("scaled"))


@query
def ensemble_flags(spark, sf_dir):
    _, scored = ensemble(spark, sf_dir)
    return scored.rows.select(
        "stream",
        "event_id",
        F.round("ensemble", 6).alias("ensemble"),
        F.round("threshold", 6).alias("threshold"),
        "is_anomaly",
    )


@query
def scores_by_detector(spark, sf_dir):
    _, scored = ensemble(spark, sf_dir)
    long = scores_long(scored.rows, ["event_id"], [d.name for d in TWO_MADS])
    return long.withColumn("score", F.round("score", 6))


FOREST = ForestDetector("isolation_forest", ("value", "k"))


@query
def forest_flags(spark, sf_dir):
    series = split_events(spark, sf_dir)
    scored, _ = FOREST.fit_and_score(series)
    return scored.select(
        "stream",
        "event_id",
        F.round("score__isolation_forest", 6).alias("score"),
        F.col("flag__isolation_forest").alias("is_anomaly"),
    )


@query
def forest_embeddings(spark, sf_dir):
    """A forest over all dimensions of the embeddings, one series per label."""
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    dims = [f"d{i}" for i in range(width)]
    rows = vectors.select(
        "label",
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(dims)],
    )
    series = fit_split(rows, ["label"], ["vec_id"])
    detector = ForestDetector("isolation_forest", tuple(dims))
    scored, _ = detector.fit_and_score(series)
    return scored.select(
        "label",
        "vec_id",
        F.round("score__isolation_forest", 6).alias("score"),
        F.col("flag__isolation_forest").alias("is_anomaly"),
    )


@query
def forest_score_range(spark, sf_dir):
    """Scores are scaled to the batch: from 0 to 1 in every series."""
    scored, _ = FOREST.fit_and_score(split_events(spark, sf_dir))
    score = F.col("score__isolation_forest")
    return scored.groupBy("stream").agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("low"), F.max(score).alias("high")
    )


@query
def forest_attribution(spark, sf_dir):
    """Which feature drives the anomaly score of each flagged event."""
    series = split_events(spark, sf_dir)
    scored, model = FOREST.fit_and_score(series)
    flagged = scored.where("flag__isolation_forest")
    attributed = attribute_forest(flagged, FOREST, model, series)
    return attributed.select(
        "stream", "event_id", *[share.alias(key) for key, share in forest_contributions(FOREST).items()]
    )


@query
def detect_all(spark, sf_dir):
    """Ingest the events and detect in every stream: MAD and forest, scores, alerts, run records."""
    store = TableStore(spark, scratch(spark, "store"))
    records = stored_events(spark, sf_dir).select(
        F.col("stream").alias("stream_name"), "observed_at", "value", "payload"
    )
    ingest_records(store, records, "parquet", {"table": "events"})
    result = detect(store)
    return result.select(
        "stream_name", "status", "observations_scored", "alerts_created",
        F.round("ensemble_threshold", 6).alias("ensemble_threshold"),
    )


@query
def detect_two_features(spark, sf_dir):
    """The same with MAD on two features, which plain SQL can follow."""
    store = TableStore(spark, scratch(spark, "store"))
    records = stored_events(spark, sf_dir).select(
        F.col("stream").alias("stream_name"), "observed_at", "value", "payload"
    )
    ingest_records(store, records, "parquet", {"table": "events"})
    config = DetectConfig(
        (
            DetectorConfig("mad_value", "mad", 0.6, {"value_key": "value"}),
            DetectorConfig("mad_k", "mad", 0.4, {"value_key": "k"}),
        )
    )
    result = detect(store, config)
    return result.select(
        "stream_name", "status", "observations_scored", "alerts_created",
        F.round("ensemble_threshold", 6).alias("ensemble_threshold"),
    )


# Alerts and explanations


def _alert_versions(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Alerts of two detection runs, the second less strict."""
    versions = []
    for place, percentile in enumerate((97.0, 95.0)):
        _, scored = ensemble(spark, sf_dir, percentile)
        versions.append(
            scored.rows.where("is_anomaly").select(
                F.concat_ws(":", "stream", "event_id").alias("alert_id"),
                F.concat_ws(":", "stream", "event_id").alias("dedupe_key"),
                F.lit(f"run{place}").alias("run_id"),
                F.round("ensemble", 6).alias("score"),
                F.timestamp_seconds(F.lit(1704067200 + place)).alias("event_at"),
                stream_id(F.col("stream")).alias("stream_id"),
            )
        )
    return versions


def _current_alerts(current: DataFrame, second: DataFrame, first: DataFrame) -> DataFrame:
    inserted = tables.mark_inserted(second, first).select("dedupe_key", "inserted")
    return current.join(inserted, "dedupe_key", "left").select(
        "alert_id", "run_id", "score", "created_at", F.coalesce("inserted", F.lit(True)).alias("inserted")
    )


@query
def alerts_current(spark, sf_dir):
    """Two detection runs, the second less strict: alerts of both, newest version each."""
    first, second = (rows.drop("stream_id") for rows in _alert_versions(spark, sf_dir))
    return _current_alerts(tables.latest_alerts(first.unionByName(second)), second, first)


@query
def alerts_compacted(spark, sf_dir):
    """The same from the store: the first run's alerts are a snapshot when the second run's come."""
    store = TableStore(spark, scratch(spark, "store"))
    log = store.logs["alert_versions"]
    whole = T.StructType.fromDDL(tables.STATE_SCHEMAS["alert_versions"])
    shaped = []
    for rows in _alert_versions(spark, sf_dir):
        rows = rows.withColumn("created_at", F.col("event_at"))
        other = [f for f in whole.fields if f.name not in rows.columns]
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in other})
        shaped.append(log.append(rows))
        log.compact(everything=True)
    first, second = shaped
    return _current_alerts(store.alerts(), second, first)


@query
def explain_mad_values(spark, sf_dir):
    series = split_events(spark, sf_dir)
    detector = TWO_MADS[0]
    flagged = detector.fit_and_score(series)[0].where("flag__mad_value")
    part = flagged.select("event_id", explain_mad(detector).alias("part"))
    detail = F.col("part")["details"]
    return part.select(
        "event_id",
        F.round(F.col("part")["contributions"]["value"], 4).alias("contribution"),
        *[F.round(detail[c].cast("double"), 6).alias(c) for c in ("observed_value", "median", "mad", "threshold")],
        F.size(F.col("part")["rules"]).alias("rules"),
        F.when(F.contains(F.col("part")["summary"], F.lit("above")), "above")
        .otherwise("below")
        .alias("direction"),
    )


@query
def primary_signal(spark, sf_dir):
    _, scored = ensemble(spark, sf_dir)
    return scored.rows.where("is_anomaly").select(
        "event_id", primary_detector([d.name for d in TWO_MADS]).alias("primary_detector")
    )


@query
def feature_contributions(spark, sf_dir):
    _, scored = ensemble(spark, sf_dir)
    total = weighted_contributions([mad_contributions(d) for d in TWO_MADS], TWO_WEIGHTS)
    return scored.rows.where("is_anomaly").select(
        "event_id", *[F.round(share, 4).alias(f"share_{key}") for key, share in total.items()]
    )


@query
def alert_explanations(spark, sf_dir):
    alerts = event_alerts(spark, sf_dir)
    why = F.col("explanation")
    return alerts.select(
        "alert_id",
        why["primary_detector"].alias("primary_detector"),
        why["ensemble_score"].alias("ensemble_score"),
        why["ensemble_threshold"].alias("ensemble_threshold"),
        why["value"].alias("value"),
        why["observed_at"].alias("observed_at"),
        why["detector_scores"]["mad_k"].alias("score_k"),
        F.size(why["rules"]).alias("rules"),
        F.size(why["detectors"]).alias("detectors"),
    )


@query
def streams_with_alerts(spark, sf_dir):
    return reports.list_streams(event_streams(spark, sf_dir), event_alerts(spark, sf_dir)).select(
        "name", "alert_count"
    )


@query
def alerts_newest(spark, sf_dir):
    """The twenty newest alerts of the error stream with their observations."""
    errors = reports.stream_by_name(event_streams(spark, sf_dir), "error").first()["stream_id"]
    newest = reports.alerts_for_stream(
        event_alerts(spark, sf_dir), event_observations(spark, sf_dir), errors, 20
    )
    return reports.dashboard_alerts(newest).select("alert_id", "observed_at", F.round("score", 6).alias("score"))


@query
def alert_details(spark, sf_dir):
    details = reports.alert_detail(
        event_alerts(spark, sf_dir), event_streams(spark, sf_dir), event_observations(spark, sf_dir)
    )
    return details.select(
        "alert_id", "stream_name", F.round("score", 6).alias("score"), "value", "observed_at",
        "ensemble_score", "ensemble_threshold",
    )


@query
def notifications(spark, sf_dir):
    details = reports.alert_detail(
        event_alerts(spark, sf_dir), event_streams(spark, sf_dir), event_observations(spark, sf_dir)
    )
    payload = reports.notification_payload(details)
    text = reports.chat_message(payload).select("alert_id", F.length("text") > 0)
    body = F.col("body")
    return payload.join(text, "alert_id").select(
        "alert_id",
        F.get_json_object(body, "$.stream").alias("stream"),
        F.get_json_object(body, "$.value").cast("double").alias("value"),
        F.get_json_object(body, "$.detector").alias("detector"),
        F.get_json_object(body, "$.observed_at").alias("observed_at"),
    )


@query
def alert_texts(spark, sf_dir):
    """Every text of an alert, whole: its summary, its rules and the chat message."""
    details = reports.alert_detail(
        event_alerts(spark, sf_dir), event_streams(spark, sf_dir), event_observations(spark, sf_dir)
    )
    seen = reports.alert_explanations(details)
    message = reports.chat_message(reports.notification_payload(details))
    return seen.select("alert_id", "summary", F.array_join("rules", "\n").alias("rules")).join(message, "alert_id")


@query
def alerts_per_run(spark, sf_dir):
    """Alert counts per run; runs are named after their stream here."""
    return reports.count_alerts(event_alerts(spark, sf_dir))


@query
def observation_counts(spark, sf_dir):
    stored = stored_events(spark, sf_dir).withColumn("stream_id", F.col("stream"))
    return reports.count_observations(stored)


# Benchmarks and injected anomalies


@query
def flag_quality(spark, sf_dir):
    """MAD flags against the hours after a user's error."""
    series = split_events(spark, sf_dir)
    detector = TWO_MADS[0]
    flags = detector.fit_and_score(series)[0].select(
        "event_id", "stream", F.col("flag__mad_value").alias("flag")
    )
    rated = flags.join(label_windows(spark, sf_dir), "event_id")
    counts = precision_recall_f1(classification_counts(rated, "label", "flag", ["stream"]))
    return counts.select(
        "stream", "true_positives", "false_positives", "false_negatives",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        F.round(false_positives_per_hour(F.col("false_positives"), F.lit(720.0)), 6).alias("per_hour"),
    )


@query
def flag_sets(spark, sf_dir):
    """The same counts from two sets of ids."""
    series = split_events(spark, sf_dir)
    detector = TWO_MADS[0]
    found = detector.fit_and_score(series)[0].where("flag__mad_value")
    truth = label_windows(spark, sf_dir).where("label = 1")
    return set_counts(truth, found, ["event_id"])


def _label_quality(spark, sf_dir, sortable_rows=None):
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars")
    )
    series = fit_split(documents, ["lang"], ["doc_id"], sortable_rows=sortable_rows)
    detector = MadDetector("mad", "n_chars")
    flags = detector.fit_and_score(series)[0].select("doc_id", F.col("flag__mad").alias("flag"))
    rated = flags.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    counts = precision_recall_f1(classification_counts(rated, "toxic", "flag"))
    return counts.select(
        "true_positives", "false_positives", "false_negatives",
        *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
    )


@query
def label_quality(spark, sf_dir):
    """Unusual document lengths per language against the toxic label."""
    return _label_quality(spark, sf_dir)


@query
def label_quality_long(spark, sf_dir):
    """The same with every language handled as a series too long for one task."""
    return _label_quality(spark, sf_dir, sortable_rows=20)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(events(spark, sf_dir), ["stream"], ["ts", "event_id"])
    return rows.select("stream", "event_id", F.col("rank").alias("idx"), "n", "value", "ts")


@query
def baseline_values(spark, sf_dir):
    """Synthetic baseline and sample value for every event position."""
    rows = _indexed(spark, sf_dir)
    return rows.select(
        "event_id",
        F.round(baseline_value(F.col("idx"), 20.0, 42, F.col("stream")), 6).alias("baseline"),
        F.round(sample_value(F.col("idx"), 42, F.col("stream")), 6).alias("sample"),
    )


@query
def sample_spikes(spark, sf_dir):
    """Sample series with spikes, as long as the series of events."""
    made = sample_series(_indexed(spark, sf_dir).drop("value"), ["stream"], 20)
    return made.select("event_id", "observed_at", F.round("value", 6).alias("value"), "spike")


@query
def labelled_sample(spark, sf_dir):
    """Labelled records, as many per stream as there are events."""
    made = labelled_records(_indexed(spark, sf_dir).drop("value"), ["stream"], 30)
    return made.select("event_id", F.round("value", 6).alias("value"), "label")


@query
def injection_places(spark, sf_dir):
    return select_indices(_indexed(spark, sf_dir), ["stream"], 50, 43)


def _injected(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    out = inject(_indexed(spark, sf_dir), ["stream"], 50, kinds, 43)
    return out.select("event_id", F.round("value", 6).alias("value"), "label")


@query
def inject_point(spark, sf_dir):
    return _injected(spark, sf_dir, ("point",))


@query
def inject_contextual(spark, sf_dir):
    return _injected(spark, sf_dir, ("contextual",))


@query
def inject_drift(spark, sf_dir):
    return _injected(spark, sf_dir, ("drift",))


@query
def inject_mixed(spark, sf_dir):
    out = inject(_indexed(spark, sf_dir), ["stream"], 50, seed=43)
    return out.select("event_id", F.round("value", 6).alias("value"), "label", "kind")


@query
def retail_sample_daily(spark, sf_dir):
    """Sample invoices for as many days as the line items span, summed per day."""
    days = table(spark, sf_dir, "lineitem").select(
        F.date_diff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("bigint").alias("day")
    )
    lines = retail_sample(days.distinct())
    daily = daily_revenue(lines, "InvoiceDate", "Quantity", "UnitPrice")
    return daily.withColumn("value", F.round("value", 4))


@query
def benchmark_injected(spark, sf_dir):
    """Quality of MAD, forest and ensemble on events with injected point anomalies, per stream."""
    rows = settle(inject(_indexed(spark, sf_dir), ["stream"], 50, ("point",), 43))
    parts = fit_splits(rows, ["stream"], ["ts", "event_id"])
    return evaluate_series(parts, BenchmarkConfig(), 60)


@query
def flags_by_detector(spark, sf_dir):
    _, scored = ensemble(spark, sf_dir)
    flags = {d.name: f"flag__{d.name}" for d in TWO_MADS} | {"ensemble": "is_anomaly"}
    long = flags_long(scored.rows, ["stream", "event_id"], flags)
    return long.groupBy("stream", "detector").agg(F.count_if("flag").alias("flagged"))


# Streaming


@query
def stream_ingest(spark, sf_dir):
    """The events as a file stream of messages, ingested in micro-batches."""
    source, checkpoint = scratch(spark, "messages"), scratch(spark, "checkpoint")
    messages(spark, sf_dir).drop("stream").repartition(4, "partition").write.parquet(source)
    stream = (
        spark.readStream.schema("value string, topic string, partition int, offset bigint")
        .option("maxFilesPerTrigger", 2)
        .parquet(source)
    )
    store = TableStore(spark, scratch(spark, "store"))
    config = MessageSourceConfig("events", topic="observations")
    consume(store, stream, config, checkpoint).awaitTermination()
    stored = store.observations()
    return stored.agg(
        F.count(F.lit(1)).alias("observations"),
        F.round(F.sum("value"), 2).alias("total"),
        F.min("observed_at").alias("first"),
        F.max("observed_at").alias("last"),
    )


