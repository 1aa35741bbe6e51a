"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Naive timestamps are UTC everywhere in this package.
    "spark.sql.session.timeZone": "UTC",
    # Bad casts must raise instead of turning into nulls.
    "spark.sql.ansi.enabled": "true",
    # INT96 carries no min/max statistics, so time filters could not skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Rows may hold long texts: small batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings every operator assumes."""
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for settled tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own, because there every
    task sees the same disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="tidewatch-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _settled_root(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/settled/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table.

    This cuts lineage so that a lost executor costs one file read, not the whole job again. It also
    gives the optimizer the true size on disk, so a join with a settled table is broadcast only
    while that size is below ``spark.sql.autoBroadcastJoinThreshold``. ``options``
    go to the Parquet writer.
    """
    spark = df.sparkSession
    path = f"{_settled_root(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def discard(settled: DataFrame) -> None:
    """Delete one settled table, when nothing built on it will run any more."""
    _delete(settled.sparkSession, settled._settled_at)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete what this application has settled. DataFrames built on it cannot be used any more."""
    _delete(spark, _settled_root(spark))
