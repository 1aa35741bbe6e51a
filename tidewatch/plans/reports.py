"""Read-side queries over streams, alerts, runs and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import iso_utc

NO_EXPLANATION = "No explanation available"


def stream_by_name(streams: DataFrame, name: str) -> DataFrame:
    """The named stream; raises when there is none."""
    found = streams.where(F.col("name") == name)
    if found.isEmpty():
        raise ValueError(f"Stream not found: {name}")
    return found


def list_streams(streams: DataFrame, alerts: DataFrame) -> DataFrame:
    """Every stream with its number of alerts, by name. Alerts are counted before the join."""
    counts = alerts.groupBy("stream_id").agg(F.count("alert_id").alias("alert_count"))
    return (
        streams.select("stream_id", "name")
        .join(counts, "stream_id", "left")
        .select("stream_id", "name", F.coalesce("alert_count", F.lit(0)).alias("alert_count"))
        .orderBy("name")
    )


def with_observations(alerts: DataFrame, observations: DataFrame) -> DataFrame:
    """Alerts with the time and payload of their observation, when it is stored."""
    seen = observations.select("stream_id", "row_fingerprint", "observed_at", "payload")
    return alerts.drop("observed_at").join(seen, ["stream_id", "row_fingerprint"], "left")


def alerts_for_stream(
    alerts: DataFrame, observations: DataFrame, stream_id: str, limit: int = 10
) -> DataFrame:
    """The newest alerts of a stream; only these are joined with their observations."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    newest = (
        alerts.where(F.col("stream_id") == stream_id)
        .orderBy(F.desc("created_at"), "alert_id")
        .limit(limit)
    )
    mine = observations.where(F.col("stream_id") == stream_id)
    return with_observations(newest, mine).orderBy(F.desc("created_at"), "alert_id")


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Explanation fields of alerts, flat, with defaults where there is no explanation."""
    why = F.col("explanation")
    return alerts.select(
        "alert_id",
        "stream_id",
        "score",
        "detector",
        iso_utc(F.col("observed_at")).alias("observed_at"),
        F.coalesce(why["summary"], F.lit(NO_EXPLANATION)).alias("summary"),
        F.coalesce(why["rules"], F.array().cast("array<string>")).alias("rules"),
        why["feature_contributions"].alias("feature_contributions"),
    )


def alert_value(payload: Column, explanation_value: Column) -> Column:
    """The observed value: from the payload when it has one, else as explained."""
    return F.coalesce(F.get_json_object(payload, "$.value").cast("double"), explanation_value)


def alert_detail(
    alerts: DataFrame, streams: DataFrame, observations: DataFrame, alert_id: str | None = None
) -> DataFrame:
    """Alerts with stream name, observation and everything explained; one alert or all."""
    wanted = alerts if alert_id is None else alerts.where(F.col("alert_id") == alert_id)
    named = wanted.join(streams.select("stream_id", F.col("name").alias("stream_name")), "stream_id")
    why = F.col("explanation")
    return with_observations(named, observations).select(
        "alert_id",
        "stream_name",
        "run_id",
        "score",
        "detector",
        "created_at",
        iso_utc(F.col("observed_at")).alias("observed_at"),
        alert_value(F.col("payload"), why["value"]).alias("value"),
        F.coalesce(why["summary"], F.lit(NO_EXPLANATION)).alias("summary"),
        F.coalesce(why["rules"], F.array().cast("array<string>")).alias("rules"),
        why["feature_contributions"].alias("feature_contributions"),
        why["ensemble_score"].alias("ensemble_score"),
        why["ensemble_threshold"].alias("ensemble_threshold"),
        why["detector_scores"].alias("detector_scores"),
        why["detectors"].alias("detectors"),
        why["summary"].alias("explained_summary"),
    )


def alert_explanations(details: DataFrame) -> DataFrame:
    """The explanation view of alerts."""
    return details.select(
        "alert_id", "score", "detector", "observed_at", "summary", "rules", "feature_contributions"
    )


def notification_payload(details: DataFrame) -> DataFrame:
    """What a notification of each alert carries, as columns and as one JSON text ``body``."""
    fields = details.select(
        "alert_id",
        F.col("stream_name").alias("stream"),
        "score",
        "detector",
        "observed_at",
        "value",
        F.col("explained_summary").alias("summary"),
        "rules",
        "feature_contributions",
    )
    body = F.to_json(F.struct(*fields.columns), {"ignoreNullFields": "false"})
    return fields.withColumn("body", body)


def chat_message(payloads: DataFrame) -> DataFrame:
    """A short text per notification."""
    summary = F.when(F.col("summary") == "", None).otherwise(F.col("summary"))
    text = F.concat(
        F.format_string(
            ":rotating_light: *Anomaly alert* — `%s`\n*Score*: `%s` at `%s`\n",
            F.col("stream"),
            F.col("score").cast("string"),
            F.coalesce("observed_at", F.lit("unknown time")),
        ),
        F.coalesce(summary, F.lit("Anomaly detected")),
    )
    return payloads.select("alert_id", text.alias("text"))


def dashboard_alerts(alerts: DataFrame) -> DataFrame:
    """The columns an alert table shows, of alerts from ``alerts_for_stream``."""
    return alert_summary(alerts).select("observed_at", "score", "summary", "alert_id")


def count_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts per run."""
    return alerts.groupBy("run_id").agg(F.count(F.lit(1)).alias("alerts"))


def count_alerts_for_run(alerts: DataFrame, run_id: str) -> DataFrame:
    return alerts.where(F.col("run_id") == run_id).agg(F.count(F.lit(1)).alias("alerts"))


def count_observations(observations: DataFrame, by: str = "stream_id") -> DataFrame:
    """Stored rows per ``stream_id`` or ``run_id``."""
    return observations.groupBy(by).agg(F.count(F.lit(1)).alias("observations"))


def list_runs(runs: DataFrame, stream_id: str, limit: int = 20) -> DataFrame:
    """The newest runs of a stream, with their counters as numbers where they were recorded."""
    about = F.col("metadata")
    return (
        runs.where(F.col("stream_id") == stream_id)
        .select(
            "run_id",
            F.coalesce("run_type", F.lit("ingestion")).alias("run_type"),
            "status",
            "started_at",
            "finished_at",
            about["observations_scored"].try_cast("bigint").alias("observations_scored"),
            about["alerts_created"].try_cast("bigint").alias("alerts_created"),
            about["row_count"].try_cast("bigint").alias("records_written"),
            "metadata",
        )
        .orderBy(F.desc("started_at"), "run_id")
        .limit(limit)
    )
