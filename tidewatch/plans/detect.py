"""Detection over stored observations: score the newest run of one, many or all streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DEFAULT_DETECT, DetectConfig
from tidewatch.operators.ensemble import score_ensemble, scores_long
from tidewatch.operators.registry import build_detector
from tidewatch.operators.split import MIN_ROWS, fit_splits, series_sizes, too_short
from tidewatch.plans.explain import explain_alerts
from tidewatch.session import settle
from tidewatch.sources.timeseries import feature
from tidewatch.tables.store import TableStore

# Most batch directories that are named one by one in a filter.
MAX_LISTED = 1000


def latest_ingestion_runs(runs: DataFrame) -> DataFrame:
    """Newest completed run with content of each stream: by finish, then by start."""
    done = runs.where(
        (F.col("status") == "completed") & F.map_contains_key("metadata", "content_hash")
    )
    newest = F.max_by(
        F.struct("run_id", F.col("metadata")["batch_id"].alias("batch_id")),
        F.struct("finished_at", "started_at", "run_id"),
    )
    return done.groupBy("stream_id").agg(newest.alias("run")).select("stream_id", "run.*")


def feature_rows(observations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observations with their features as columns; a missing feature fails the job."""
    rows = observations.select(
        "stream_id",
        F.col("run_id").alias("source_run_id"),
        "observed_at",
        "row_fingerprint",
        *[feature(key).alias(key) for key in keys],
    )
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    missing = F.raise_error(F.lit(f"an observation lacks one of the features {list(keys)}"))
    return rows.where(F.when(complete, True).otherwise(missing.cast("boolean")))


def detect(
    store: TableStore,
    config: DetectConfig = DEFAULT_DETECT,
    streams: Sequence[str] | None = None,
    on_alerts: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Score the newest run of the named streams (all by default) and store scores and alerts.

    Returns one row per stream: ``run_id``, ``stream_id``, ``stream_name``, ``source_run_id``,
    ``status``, ``observations_scored``, ``alerts_created``, ``ensemble_threshold``. Streams with too
    few observations are reported as failed; when they are all there is, or a stream was named that
    cannot be scored at all, the call raises. ``on_alerts`` gets every stored alert of the call, with
    ``inserted`` telling new ones from updates.
    """
    known = store.streams().select("stream_id", F.col("name").alias("stream_name"))
    if streams is not None:
        known = known.where(F.col("stream_name").isin(list(streams)))
    chosen = settle(
        known.join(
            latest_ingestion_runs(store.runs(of=None if streams is None else known)), "stream_id", "left"
        )
    )
    if streams is not None:
        found = {row.stream_name: row.run_id for row in chosen.select("stream_name", "run_id").collect()}
        for name in streams:
            if name not in found:
                raise ValueError(f"Stream not found: {name}")
            if found[name] is None:
                raise ValueError(f"No completed ingestion run for stream: {name}")
    sources = chosen.where(F.col("run_id").isNotNull())

    detectors = [build_detector(item) for item in config.detectors]
    weights = [item.weight for item in config.detectors]
    names = [d.name for d in detectors]
    features = list(dict.fromkeys(key for d in detectors for key in d.feature_keys))

    stored = store.observations()
    batches = [row.batch_id for row in sources.select("batch_id").distinct().limit(MAX_LISTED + 1).collect()]
    if len(batches) <= MAX_LISTED:
        # Names the directories to read; with more batches the join alone selects the rows.
        stored = stored.where(F.col("batch_id").isin(batches))
    run_keys = ["stream_id", "run_id", "batch_id"]
    stored = stored.join(sources.select(*run_keys), run_keys, "left_semi")
    # Parse the payload once; every later pass reads only these narrow columns.
    rows = settle(feature_rows(stored, features))
    sizes = series_sizes(rows, ["stream_id"])

    batch = uuid.uuid4().hex
    ids = F.sha2(F.concat_ws("|", F.col("stream_id"), F.col("source_run_id"), F.lit(batch)), 256)
    runs = settle(
        sources.select("stream_id", "stream_name", F.col("run_id").alias("source_run_id"))
        .withColumn("run_id", ids)
        .join(sizes, "stream_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    short = too_short(runs)
    enough = runs.where(F.col("n") >= MIN_ROWS)
    about = {"source_run_id": F.col("source_run_id"), "stream_name": F.col("stream_name")}
    reason = F.format_string(
        f"Not enough observations to detect (need >= {MIN_ROWS}, got %d)", F.col("n")
    )
    if enough.isEmpty():
        first = short.select(reason.alias("reason")).first()
        raise ValueError(first["reason"] if first else "No stream with a completed ingestion run")

    store.record_runs(runs, "detection", "running", {**about, "batch_id": batch})
    if not short.isEmpty():
        store.record_runs(short, "detection", "failed", {"error": reason})
    try:
        ready = rows.join(enough.select("stream_id", "run_id"), "stream_id")
        order = ["observed_at", "row_fingerprint"]
        tables: list[DataFrame] = []
        alerting: list[DataFrame] = []
        for series in fit_splits(ready, ["stream_id"], order, config.fit_ratio):
            result = score_ensemble(series, detectors, weights, config.percentile)
            tables.append(settle(result.rows))
            alerting.append(
                explain_alerts(
                    tables[-1].where("is_anomaly"), series, detectors, result.models, weights,
                    config.value_key,
                )
            )
        scored = reduce(DataFrame.unionByName, tables)
        explained = reduce(DataFrame.unionByName, alerting)
        store.append_scores(
            scores_long(scored, ["run_id", "stream_id", "row_fingerprint"], names), batch
        )
        dedupe_key = F.concat_ws(":", "stream_id", "row_fingerprint", F.lit("ensemble"))
        alerts = store.upsert_alerts(
            explained.withColumn("dedupe_key", dedupe_key)
            .withColumn("alert_id", F.sha2("dedupe_key", 256))
            .withColumn("detector", F.lit("ensemble"))
            .withColumn("score", F.col("ensemble")),
            batch,
        )
        if on_alerts is not None:
            on_alerts(alerts)
        created = alerts.groupBy("stream_id").agg(F.count_if("inserted").alias("alerts_created"))
        finished = settle(
            enough.join(created, "stream_id", "left")
            .join(
                scored.groupBy("stream_id").agg(F.any_value("threshold").alias("threshold")),
                "stream_id",
            )
            .withColumn("alerts_created", F.coalesce("alerts_created", F.lit(0)))
        )
        store.record_runs(
            finished,
            "detection",
            "completed",
            {
                **about,
                "observations_scored": F.col("n"),
                "alerts_created": F.col("alerts_created"),
                "ensemble_threshold": F.col("threshold"),
            },
        )
    except Exception as error:
        store.record_runs(enough, "detection", "failed", {"error": str(error)})
        raise
    columns = ["run_id", "stream_id", "stream_name", "source_run_id"]
    done = finished.select(
        *columns,
        F.lit("completed").alias("status"),
        F.col("n").alias("observations_scored"),
        "alerts_created",
        F.col("threshold").alias("ensemble_threshold"),
    )
    failed = short.select(
        *columns,
        F.lit("failed").alias("status"),
        F.lit(0).cast("bigint").alias("observations_scored"),
        F.lit(0).cast("bigint").alias("alerts_created"),
        F.lit(None).cast("double").alias("ensemble_threshold"),
    )
    return done.unionByName(failed)
