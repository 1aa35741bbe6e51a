"""JSON observation messages from a topic, in batch or streaming form.

Everything works on a DataFrame with the columns of Spark's Kafka source (``value``, ``topic``,
``partition``, ``offset``), so a file stream with the same columns runs the same code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.config import MessageSourceConfig
from tidewatch.functions.times import parse_iso


def kafka_stream(spark: SparkSession, config: MessageSourceConfig) -> DataFrame:
    """A streaming read of the topic; needs Spark's Kafka package on the class path.

    The checkpoint of the streaming query takes the place of the consumer group: offsets are
    committed after the batch was written.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", config.bootstrap_servers)
        .option("subscribe", config.topic)
        .option("startingOffsets", config.auto_offset_reset)
    )
    if config.max_messages is not None:
        reader = reader.option("maxOffsetsPerTrigger", config.max_messages)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), "topic", "partition", "offset"
    )


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    As a plain projection it would be copied into every later filter and column that uses it; the
    optimizer does not move expressions through a generator.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def _parsed(df: DataFrame, timestamp_field: str, value_field: str) -> DataFrame:
    """Parsed fields next to the message, and ``problem``: null when the message is good."""
    staged = _once(df, "document", F.try_parse_json("value"))
    staged = _once(staged, "fields", F.try_variant_get("document", "$", "map<string,variant>"))
    time, number = F.col("fields")[timestamp_field], F.col("fields")[value_field]
    is_text = F.schema_of_variant(time) == "STRING"
    reading = F.struct(
        F.when(is_text, parse_iso(F.try_variant_get(time, "$", "string"))).alias("observed_at"),
        F.try_variant_get(number, "$", "double").alias("number"),
    )
    staged = _once(staged, "reading", reading).select("*", "reading.*")
    problem = (
        F.when(F.col("fields").isNull(), F.lit("Expected JSON object in message"))
        .when(
            ~F.map_contains_key("fields", timestamp_field),
            F.lit(f"Missing timestamp field in message: {timestamp_field}"),
        )
        .when(
            ~F.map_contains_key("fields", value_field),
            F.lit(f"Missing value field in message: {value_field}"),
        )
        .when(F.col("observed_at").isNull(), F.lit("Unsupported timestamp value"))
        .when(F.col("number").isNull() | F.isnan("number"), F.lit("Unsupported value"))
    )
    return staged.withColumn("problem", problem)


def _payload(value_field: str, timestamp_field: str) -> Column:
    """Other fields as they came, the numeric value, and where the message was read from.

    A variant keeps the keys of an object sorted, at every level.
    """
    taken = [timestamp_field, value_field, "kafka"]
    others = F.map_filter("fields", lambda key, _: ~key.isin(taken))
    origin = F.to_variant_object(F.struct("topic", "partition", "offset"))
    own = F.create_map(
        F.lit(value_field), F.col("number").cast("variant"), F.lit("kafka"), origin
    )
    return F.to_json(F.to_variant_object(F.map_concat(others, own)))


def parse_messages(
    df: DataFrame, timestamp_field: str = "timestamp", value_field: str = "value"
) -> DataFrame:
    """Good messages as ``observed_at``, ``value``, ``payload``; the first bad one fails the job."""
    staged = _parsed(df, timestamp_field, value_field)
    fail = F.raise_error(F.concat(F.col("problem"), F.lit(" at offset "), F.col("offset").cast("string")))
    good = staged.where(F.when(F.col("problem").isNull(), True).otherwise(fail.cast("boolean")))
    return _observations(good, timestamp_field, value_field)


def split_messages(
    df: DataFrame, timestamp_field: str = "timestamp", value_field: str = "value"
) -> tuple[DataFrame, DataFrame]:
    """Good messages as in ``parse_messages``, and bad ones with the ``problem`` found."""
    staged = _parsed(df, timestamp_field, value_field)
    good = _observations(staged.where(F.col("problem").isNull()), timestamp_field, value_field)
    bad = staged.where(F.col("problem").isNotNull()).select(*df.columns, "problem")
    return good, bad


def _observations(staged: DataFrame, timestamp_field: str, value_field: str) -> DataFrame:
    return staged.select(
        "observed_at",
        F.col("number").alias("value"),
        _payload(value_field, timestamp_field).alias("payload"),
        "topic",
        "partition",
        "offset",
    )


def offset_ranges(df: DataFrame) -> DataFrame:
    """First and last offset and number of messages per topic and partition."""
    return df.groupBy("topic", "partition").agg(
        F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
        F.count(F.lit(1)).alias("messages"),
    )
