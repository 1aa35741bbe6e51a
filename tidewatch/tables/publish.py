"""Rows as JSON messages for a topic or for files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.times import iso_utc


def publish_json(
    df: DataFrame, timestamp_column: str, value_column: str, source: str
) -> DataFrame:
    """Rows as JSON messages ``{time, value, source}`` in a ``value`` column, as Kafka sinks take."""
    body = F.struct(
        iso_utc(F.col(timestamp_column)).alias(timestamp_column),
        F.col(value_column).cast("double").alias(value_column),
        F.lit(source).alias("source"),
    )
    return df.select(F.to_json(body).alias("value"))


def write_topic(messages: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """Send messages to a topic; needs Spark's Kafka package on the class path."""
    (
        messages.write.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic)
        .save()
    )


def write_files(messages: DataFrame, path: str) -> None:
    """One message per line."""
    messages.write.text(path)
