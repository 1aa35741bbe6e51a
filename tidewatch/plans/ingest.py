"""Ingestion: read a source, skip what is known, store the rest, keep a run record."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import (
    FileSourceConfig,
    LabelledSourceConfig,
    QuerySourceConfig,
    RetailSourceConfig,
    SourceConfig,
)
from tidewatch.functions.hashing import content_digest, row_fingerprint, stream_id
from tidewatch.session import settle
from tidewatch.sources.registry import build_source
from tidewatch.tables.store import TableStore, batch_key, series_names


def fingerprinted(records: DataFrame) -> DataFrame:
    """Add ``stream_id`` and ``row_fingerprint`` to records that have a ``stream_name``."""
    return records.withColumn("stream_id", stream_id(F.col("stream_name"))).withColumn(
        "row_fingerprint",
        row_fingerprint(F.col("stream_id"), F.col("observed_at"), F.col("payload")),
    )


def run_id(stream: Column, digest: Column, run_type: str) -> Column:
    """Id of the run that handles this content for this stream; a retry has the same id."""
    return F.sha2(F.concat_ws("|", stream, digest, F.lit(run_type)), 256)


def content_hashes(rows: DataFrame) -> DataFrame:
    """Digest and number of the records of each stream; the order of records does not matter."""
    return rows.groupBy("stream_id").agg(
        content_digest(F.col("row_fingerprint")).alias("content_hash"),
        F.count(F.lit(1)).alias("records_read"),
    )


def batch_content_hash(rows: DataFrame) -> DataFrame:
    """As ``content_hashes``, with the offsets the messages were read from in the digest."""
    placed = F.sha2(F.concat_ws("|", "row_fingerprint", "topic", "partition", "offset"), 256)
    return rows.groupBy("stream_id").agg(
        content_digest(placed).alias("content_hash"), F.count(F.lit(1)).alias("records_read")
    )


def completed_runs(runs: DataFrame) -> DataFrame:
    """Completed ingestion runs with the content they stored."""
    return runs.where(
        (F.col("status") == "completed") & F.map_contains_key("metadata", "content_hash")
    ).select(
        "stream_id",
        F.col("metadata")["content_hash"].alias("content_hash"),
        F.col("run_id").alias("known_run"),
        F.col("metadata")["row_count"].try_cast("bigint").alias("known_rows"),
    )


def source_metadata(config: SourceConfig) -> dict[str, str]:
    if isinstance(config, FileSourceConfig | LabelledSourceConfig | RetailSourceConfig):
        return {"source_path": str(config.path)}
    if isinstance(config, QuerySourceConfig):
        return {"query": config.query}
    return {}


def ingest(store: TableStore, config: SourceConfig) -> DataFrame:
    """Ingest one configured source; the result is one row, as in ``ingest_records``."""
    records = build_source(store.spark, config).withColumn("stream_name", F.lit(config.name))
    return ingest_records(
        store,
        records,
        config.source_type,
        config.as_json_dict(),
        source_metadata(config),
        names=series_names([config.name], store.spark),
    )


def ingest_records(
    store: TableStore,
    records: DataFrame,
    source_type: str,
    config: Mapping[str, Any],
    metadata: Mapping[str, str] | None = None,
    names: DataFrame | None = None,
    with_offsets: bool = False,
) -> DataFrame:
    """Ingest records of any number of streams (``stream_name``) in one job.

    Content that a completed run of the stream already stored is skipped. The result has one row per
    stream: ``run_id``, ``stream_id``, ``stream_name``, ``records_read``, ``records_written``,
    ``records_duplicate``, ``content_hash``, ``skipped``.
    """
    rows = settle(fingerprinted(records))
    if names is None:
        names = rows.select(F.col("stream_name").alias("name")).distinct()
    streams = settle(store.upsert_streams(names, source_type, config))

    digests = batch_content_hash(rows) if with_offsets else content_hashes(rows)
    nothing = F.sha2(F.lit("0"), 256)
    known = completed_runs(store.runs(of=streams))
    planned = settle(
        streams.join(digests, "stream_id", "left")
        .withColumn("content_hash", F.coalesce("content_hash", nothing))
        .withColumn("records_read", F.coalesce("records_read", F.lit(0)))
        .withColumn("run_id", run_id(F.col("stream_id"), F.col("content_hash"), "ingestion"))
        .join(known, ["stream_id", "content_hash"], "left")
        .withColumn("skipped", F.col("known_run").isNotNull())
    )
    fresh = planned.where(~F.col("skipped"))
    skipped = planned.where("skipped").select(
        F.col("known_run").alias("run_id"),
        "stream_id",
        F.col("name").alias("stream_name"),
        F.coalesce("known_rows", F.lit(0)).alias("records_read"),
        F.lit(0).cast("bigint").alias("records_written"),
        F.lit(0).cast("bigint").alias("records_duplicate"),
        "content_hash",
        "skipped",
    )
    if fresh.isEmpty():
        return skipped

    batch = batch_key(fresh)
    about: dict[str, Column | str | int] = {
        "content_hash": F.col("content_hash"),
        "source_type": source_type,
        "batch_id": batch,
        **(metadata or {}),
    }
    store.record_runs(fresh, "ingestion", "running", about)
    try:
        incoming = rows.drop("stream_name").join(fresh.select("stream_id", "run_id"), "stream_id")
        written = store.append_observations(incoming, batch)
        counts = settle(written.groupBy("run_id").agg(F.count(F.lit(1)).alias("records_written")))
        finished = settle(
            fresh.join(counts, "run_id", "left").select(
                "run_id",
                "stream_id",
                F.col("name").alias("stream_name"),
                "records_read",
                F.coalesce("records_written", F.lit(0)).alias("records_written"),
                "content_hash",
                "skipped",
            )
        )
        duplicates = F.col("records_read") - F.col("records_written")
        store.record_runs(
            finished,
            "ingestion",
            "completed",
            {**about, "row_count": F.col("records_written"), "records_read": F.col("records_read")},
        )
    except Exception as error:
        store.record_runs(fresh, "ingestion", "failed", {"error": str(error)})
        raise
    return finished.withColumn("records_duplicate", duplicates).select(*skipped.columns).unionByName(
        skipped
    )
