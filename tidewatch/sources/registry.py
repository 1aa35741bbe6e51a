"""Sources by type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.config import (
    FileSourceConfig,
    LabelledSourceConfig,
    MessageSourceConfig,
    QuerySourceConfig,
    RetailSourceConfig,
    SourceConfig,
)
from tidewatch.sources.labelled import labelled_source
from tidewatch.sources.messages import kafka_stream, parse_messages
from tidewatch.sources.query import sql_source
from tidewatch.sources.retail import retail_source
from tidewatch.sources.timeseries import observations, scan_csv, scan_parquet


def _file(spark: SparkSession, config: FileSourceConfig) -> DataFrame:
    scan = scan_parquet if config.format == "parquet" else scan_csv
    return observations(
        scan(spark, config.path, config.schema),
        config.timestamp_column,
        config.value_column,
        config.include_columns,
    )


def _labelled(spark: SparkSession, config: LabelledSourceConfig) -> DataFrame:
    return labelled_source(
        spark,
        config.path,
        config.dataset_name,
        config.timestamp_column,
        config.value_column,
        config.labels_path,
        config.labels_key,
    )


def _retail(spark: SparkSession, config: RetailSourceConfig) -> DataFrame:
    return retail_source(
        spark,
        config.path,
        config.timestamp_column,
        config.quantity_column,
        config.price_column,
        config.aggregate,
    )


def _query(spark: SparkSession, config: QuerySourceConfig) -> DataFrame:
    return sql_source(
        spark, config.query, config.timestamp_column, config.value_column, config.jdbc_url
    )


def _messages(spark: SparkSession, config: MessageSourceConfig) -> DataFrame:
    return parse_messages(kafka_stream(spark, config), config.timestamp_field, config.value_field)


_SOURCES: dict[type[SourceConfig], Callable[[SparkSession, SourceConfig], DataFrame]] = {
    FileSourceConfig: _file,
    LabelledSourceConfig: _labelled,
    RetailSourceConfig: _retail,
    QuerySourceConfig: _query,
    MessageSourceConfig: _messages,
}


def register_source(
    config_type: type[SourceConfig], read: Callable[[SparkSession, SourceConfig], DataFrame]
) -> None:
    """Make a source of your own readable: ``read`` returns observed_at, value and payload."""
    _SOURCES[config_type] = read


def build_source(spark: SparkSession, config: SourceConfig) -> DataFrame:
    if type(config) not in _SOURCES:
        raise ValueError(f"Unsupported source config: {config!r}")
    return _SOURCES[type(config)](spark, config)
