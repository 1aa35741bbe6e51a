"""Observations from a SQL snapshot, and the snapshots the sample configurations use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import coerce_utc
from tidewatch.sources.timeseries import observations


def sql_source(
    spark: SparkSession,
    query: str,
    timestamp_column: str,
    value_column: str,
    jdbc_url: str | None = None,
) -> DataFrame:
    """Run ``query`` over the registered views, or in the database behind ``jdbc_url``."""
    text = query.strip().rstrip(";")
    if jdbc_url is None:
        result = spark.sql(text)
    else:
        result = spark.read.format("jdbc").options(url=jdbc_url, query=text).load()
    return observations(result, timestamp_column, value_column)


def hourly_count(df: DataFrame, timestamp_column: str) -> DataFrame:
    hour = F.date_trunc("hour", coerce_utc(F.col(timestamp_column))).alias("observed_at")
    return df.groupBy(hour).agg(F.count(F.lit(1)).cast("double").alias("value"))


def hourly_mean(df: DataFrame, timestamp_column: str, value_column: str) -> DataFrame:
    hour = F.date_trunc("hour", coerce_utc(F.col(timestamp_column))).alias("observed_at")
    return df.groupBy(hour).agg(F.avg(value_column).alias("value"))


def replay(
    observations_table: DataFrame, streams: DataFrame, name: str | None = None
) -> DataFrame:
    """Stored values read back out of their JSON payload, of one named stream or of all."""
    wanted = streams.select("stream_id", F.col("name").alias("stream_name"))
    if name is not None:
        wanted = wanted.where(F.col("stream_name") == name)
    value = F.get_json_object("payload", "$.value").cast("double").alias("value")
    return observations_table.join(wanted, "stream_id").select("stream_name", "observed_at", value)
