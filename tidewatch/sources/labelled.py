"""Series with labelled anomaly windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.times import coerce_utc
from tidewatch.operators.order_stats import ranked
from tidewatch.session import settle
from tidewatch.sources.timeseries import (
    conform_timeseries,
    observations,
    require_columns,
    scan_csv,
    validate_not_null,
)

WINDOWS_SCHEMA = T.StructType(
    [T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())]
)
# Windows are matched through time buckets of this length.
BUCKET_SECONDS = 86_400


def label_key_candidates(labels_key: str) -> list[str]:
    """Names under which a label file may list a dataset, in order of preference."""
    return [labels_key, f"realKnownCause/{labels_key}.csv", f"realKnownCause/{labels_key}"]


def load_anomaly_windows(
    spark: SparkSession, labels_path: str | None, labels_key: str
) -> DataFrame:
    """``start`` and ``end`` of each window listed for the dataset.

    A missing file, a file that is not a JSON object and an unknown key all give no windows;
    entries that are not pairs are skipped. A label file is one JSON document.
    """
    none = spark.createDataFrame([], WINDOWS_SCHEMA)
    if labels_path is None:
        return none
    try:
        text = spark.read.text(labels_path, wholetext=True)
    except Exception as error:  # the class depends on the client in use
        if "PATH_NOT_FOUND" in str(error):
            return none
        raise
    candidates = F.array(*[F.lit(c) for c in label_key_candidates(labels_key)])
    listed = (
        text.select(F.explode(F.from_json("value", "map<string,variant>")).alias("key", "windows"))
        .withColumn("preference", F.array_position(candidates, F.col("key")))
        .where(F.col("preference") > 0)
        .orderBy("preference")
        .limit(1)
    )
    pairs = F.expr("try_variant_get(windows, '$', 'array<variant>')")
    return (
        listed.select(F.explode(pairs).alias("entry"))
        .select(F.expr("try_variant_get(entry, '$', 'array<string>')").alias("pair"))
        .where(F.size("pair") == 2)
        .select(
            F.element_at("pair", 1).cast("timestamp").alias("start"),
            F.element_at("pair", 2).cast("timestamp").alias("end"),
        )
    )


def merge_windows(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping windows of a key joined into disjoint ones. Both ends belong to a window."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        windows.where(F.col("start") <= F.col("end"))
        .withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("opens").over(order))
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def _day(moment: Column) -> Column:
    return F.floor(F.unix_micros(moment) / (BUCKET_SECONDS * 1_000_000))


def label_by_windows(
    df: DataFrame, windows: DataFrame, timestamp_column: str, keys: Sequence[str], label: str = "label"
) -> DataFrame:
    """Add ``label``: 1 when the time lies in a window of the same key, ends included, else 0.

    Windows are cut at day boundaries and made disjoint within a key and day, so both the merge and
    the join work on one day of one key at a time, each row meets at most one window, and no row is
    emitted twice.
    """
    on = [*keys, "day"]
    days = F.explode(F.sequence(_day(F.col("start")), _day(F.col("end"))))
    by_day = (
        windows.where(F.col("start") <= F.col("end"))
        .withColumn("day", days)
        .withColumn("opening", F.timestamp_seconds(F.col("day") * BUCKET_SECONDS))
        .withColumn("closing", F.timestamp_seconds((F.col("day") + 1) * BUCKET_SECONDS))
        .select(
            *on,
            F.greatest("start", "opening").alias("start"),
            # The next day's piece begins where this one ends; a row looks at its own day only.
            F.least("end", "closing").alias("end"),
        )
    )
    # Settled, so that the optimizer knows whether the windows are small enough to broadcast.
    disjoint = settle(merge_windows(by_day, on))
    moment = coerce_utc(F.col(timestamp_column))
    rows = df.withColumn("moment", moment).withColumn("day", _day(F.col("moment")))
    r, w = rows.alias("r"), disjoint.alias("w")
    match = (F.col("r.moment") >= F.col("w.start")) & (F.col("r.moment") <= F.col("w.end"))
    for key in on:
        match = match & (F.col(f"r.{key}") == F.col(f"w.{key}"))
    return r.join(w, match, "left").select(
        *[F.col(f"r.{c}") for c in df.columns],
        F.col("w.start").isNotNull().cast("int").alias(label),
    )


def labelled_source(
    spark: SparkSession,
    path: str,
    dataset_name: str,
    timestamp_column: str = "timestamp",
    value_column: str = "value",
    labels_path: str | None = None,
    labels_key: str | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """A CSV series whose payload also has ``dataset`` and the point ``label``.

    ``seen`` is told ``points`` and ``labelled_points`` by the first job that reads all rows, in the same
    pass.
    """
    raw = scan_csv(spark, path)
    conformed = validate_not_null(
        conform_timeseries(raw, timestamp_column, value_column), timestamp_column, value_column
    )
    windows = load_anomaly_windows(spark, labels_path, labels_key or dataset_name)
    # All windows are those of this one dataset.
    named = conformed.withColumn("dataset", F.lit(dataset_name)).drop("label")
    labelled = label_by_windows(
        named, windows.withColumn("dataset", F.lit(dataset_name)), timestamp_column, ["dataset"]
    )
    if seen is not None:
        labelled = labelled.observe(
            seen,
            F.count(F.lit(1)).alias("points"),
            F.count_if(F.col("label") == 1).alias("labelled_points"),
        )
    return observations(labelled, timestamp_column, value_column)


def labelled_csv(
    spark: SparkSession,
    path: str,
    timestamp_column: str = "timestamp",
    value_column: str = "value",
    label_column: str = "label",
) -> DataFrame:
    """Benchmark rows ``idx``, ``observed_at``, ``value``, ``label``; rows are numbered by time.

    ``path`` may name a folder or several files. Rows with the same time keep the order of the names of
    their files and, within a file, the order in which they appear there, however the files are read.
    """
    raw = scan_csv(spark, path)
    require_columns(raw, [timestamp_column, value_column, label_column])
    rows = raw.select(
        F.col(timestamp_column).cast("timestamp").alias("observed_at"),
        F.col(value_column).cast("double").alias("value"),
        (F.col(label_column).cast("int") != 0).alias("label"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        # A block is read by one task, from its first row to its last.
        F.monotonically_increasing_id().alias("line"),
        F.lit(0).alias("series"),
    )
    numbered = ranked(rows, ["series"], ["observed_at", "file", "block", "line"])
    return numbered.select(F.col("rank").alias("idx"), "observed_at", "value", "label")
