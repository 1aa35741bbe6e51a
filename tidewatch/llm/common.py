"""Helpers the training-data operators share."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import configure, settle

# What counts as white space between words, and so what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def travels_with_tasks(module: str) -> None:
    """Send a module's functions to the executors by value: they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m", rows: int = 4) -> Iterator[None]:
    """While tables of long rows are read by Python: fewer of them at a time.

    ``rows`` are decoded together; a batch for Python closes with the row that brings it to ``size``.
    """
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": size,
        "spark.sql.parquet.columnarReaderBatchSize": str(rows),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, has this remainder; a null id is in no fold."""
    hashed = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(hashed % modulus == remainder, F.lit(False))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Append each row's 0-based position in the total order of ``order``.

    One range-partitioned sort; only the row counts of the partitions meet in one place. Rows that
    agree in all of ``order`` land in one task, so ``order`` should end in something unique.
    """
    columns = df.columns
    parted = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    starts = settle(sizes.select("_part", before.alias("_start")))
    within = Window.partitionBy("_part").orderBy(*order)
    position = (F.col("_start") + F.row_number().over(within) - 1).cast("long")
    return parted.join(starts, "_part").select(*columns, position.alias(name))
