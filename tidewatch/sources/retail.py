"""Invoice lines aggregated to a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import coerce_utc
from tidewatch.sources.timeseries import payload_json, require_columns, scan_csv


def _daily(df: DataFrame, timestamp_column: str, amount) -> DataFrame:
    day = F.date_trunc("day", coerce_utc(F.col(timestamp_column))).alias("observed_at")
    return df.groupBy(day).agg(
        F.coalesce(F.sum(amount), F.lit(0.0)).alias("value"),
        F.count(F.lit(1)).alias("invoice_lines"),
    )


def daily_revenue(
    df: DataFrame, timestamp_column: str, quantity_column: str, price_column: str
) -> DataFrame:
    """Per day: sum of quantity x price, and number of lines. Lines without an amount still count."""
    quantity, price = F.col(quantity_column).cast("double"), F.col(price_column).cast("double")
    return _daily(df, timestamp_column, quantity * price)


def daily_quantity(df: DataFrame, timestamp_column: str, quantity_column: str) -> DataFrame:
    """Per day: sum of quantity, and number of lines."""
    return _daily(df, timestamp_column, F.col(quantity_column).cast("double"))


def retail_source(
    spark: SparkSession,
    path: str,
    timestamp_column: str = "InvoiceDate",
    quantity_column: str = "Quantity",
    price_column: str = "UnitPrice",
    aggregate: str = "daily_revenue",
) -> DataFrame:
    """Daily observations with payload ``{value, aggregate, invoice_lines}``; gaps stay gaps."""
    raw = scan_csv(spark, path)
    require_columns(raw, [timestamp_column, quantity_column, price_column])
    undated = F.raise_error(F.lit(f"null in {timestamp_column}")).cast("boolean")
    dated = raw.where(F.when(F.col(timestamp_column).isNotNull(), True).otherwise(undated))
    if aggregate == "daily_quantity":
        daily = daily_quantity(dated, timestamp_column, quantity_column)
    elif aggregate == "daily_revenue":
        daily = daily_revenue(dated, timestamp_column, quantity_column, price_column)
    else:
        raise ValueError(f"unknown aggregate: {aggregate}")
    daily = daily.withColumn("aggregate", F.lit(aggregate))
    payload = payload_json(daily, ["value", "aggregate", "invoice_lines"])
    return daily.select("observed_at", "value", payload.alias("payload"))
