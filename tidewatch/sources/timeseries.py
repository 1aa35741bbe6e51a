"""The common shape of every source: ``observed_at``, ``value`` and a canonical JSON ``payload``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from tidewatch.functions.times import coerce_utc, iso_utc


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "required") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing {what} columns: {missing}")


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Columns are text unless ``schema`` (DDL) types them: inferring the types
    would read the data twice."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def scan_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def conform_timeseries(df: DataFrame, timestamp_column: str, value_column: str) -> DataFrame:
    """Cast time to a UTC timestamp and value to double; text that does not parse fails the job."""
    require_columns(df, [timestamp_column], "timestamp")
    require_columns(df, [value_column], "value")
    return df.withColumns(
        {
            timestamp_column: coerce_utc(F.col(timestamp_column)),
            value_column: F.col(value_column).cast("double"),
        }
    )


def is_valid(timestamp_column: str, value_column: str) -> Column:
    value = F.col(value_column)
    return F.col(timestamp_column).isNotNull() & value.isNotNull() & ~F.isnan(value)


def validate_not_null(df: DataFrame, timestamp_column: str, value_column: str) -> DataFrame:
    """Fail on a null time or a null or NaN value.

    The check is a filter: as a column it would be pruned together with an unused result.
    """
    message = F.lit(f"null or NaN in {timestamp_column} or {value_column}")
    good = is_valid(timestamp_column, value_column)
    return df.where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))


def split_invalid(
    df: DataFrame, timestamp_column: str, value_column: str
) -> tuple[DataFrame, DataFrame]:
    """Good rows, conformed, and bad rows as they came: the lenient form of the two steps above."""
    require_columns(df, [timestamp_column], "timestamp")
    require_columns(df, [value_column], "value")
    time = F.col(timestamp_column).try_cast("timestamp")
    value = F.col(value_column).try_cast("double")
    good = time.isNotNull() & value.isNotNull() & ~F.coalesce(F.isnan(value), F.lit(False))
    accepted = df.where(good).withColumns({timestamp_column: time, value_column: value})
    return accepted, df.where(~good)


def payload_columns(
    df: DataFrame, timestamp_column: str, include_columns: Sequence[str] | None = None
) -> list[str]:
    """Columns of the payload: all but the time, or the listed ones that exist."""
    if include_columns is None:
        return [c for c in df.columns if c != timestamp_column]
    return [c for c in dict.fromkeys(include_columns) if c in df.columns and c != timestamp_column]


def payload_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """Canonical JSON of the columns: sorted keys, nulls kept, timestamps as UTC ISO text."""
    fields = []
    for name in sorted(columns):
        column = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (TimestampType, TimestampNTZType)):
            column = iso_utc(column)
        elif isinstance(df.schema[name].dataType, DateType):
            column = column.cast("string")
        fields.append(column.alias(name))
    if not fields:
        return F.lit("{}")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def observations(
    df: DataFrame,
    timestamp_column: str,
    value_column: str,
    include_columns: Sequence[str] | None = None,
    extra: Mapping[str, Column] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Validated rows as ``observed_at``, ``value``, ``payload``, plus the ``carry`` columns.

    ``extra`` columns go into the payload and override a source column of the same name; they may
    be constants or depend on the row.
    """
    checked = validate_not_null(
        conform_timeseries(df, timestamp_column, value_column), timestamp_column, value_column
    )
    keep = payload_columns(checked.drop(*carry), timestamp_column, include_columns)
    value = F.col(value_column).alias("value")
    if extra:
        checked = checked.withColumn("__value", F.col(value_column)).withColumns(dict(extra))
        keep = list(dict.fromkeys([*keep, *extra]))
        value = F.col("__value").alias("value")
    return checked.select(
        F.col(timestamp_column).alias("observed_at"),
        value,
        payload_json(checked, keep).alias("payload"),
        *carry,
    )


def feature(key: str) -> Column:
    """A payload field as a double: null when absent, an error when it is not a number."""
    quote = '"' if "'" in key else "'"
    return F.variant_get(F.parse_json("payload"), f"$[{quote}{key}{quote}]", "double")
