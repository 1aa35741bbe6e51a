"""The stored tables: append-only Parquet, with "current" rows as views.

Observations and scores are partitioned by ``batch_id``, one directory per job, so that a job that is run
again replaces its own output and a reader of named batches lists their directories only. One batch may
hold any number of streams. Only one writer per stream may run at a time. An index tells which batches may
hold a key, see ``membership``. Streams, runs and alerts are states with a compacted snapshot, see ``log``.

Rows of a run count once the run is completed. A stream is deleted by a record: whatever was written up to
its time is left out by every read, and is gone when tables are compacted (``purge``).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.hashing import content_digest, legacy_fingerprint, stream_id
from tidewatch.session import configure, settle
from tidewatch.tables.log import GRACE_SECONDS, StateLog, buckets
from tidewatch.tables.membership import MembershipIndex

DETECTOR_EXPLANATION = (
    "struct<detector:string,summary:string,rules:array<string>,"
    "contributions:map<string,double>,details:map<string,string>>"
)
EXPLANATION = (
    "struct<summary:string,primary_detector:string,ensemble_score:double,"
    "ensemble_threshold:double,observed_at:string,value:double,"
    "detector_scores:map<string,double>,feature_contributions:map<string,double>,"
    f"rules:array<string>,detectors:array<{DETECTOR_EXPLANATION}>>"
)

SCHEMAS = {
    "observations": "stream_id string, run_id string, observed_at timestamp, value double, "
    "payload string, row_fingerprint string, written_at timestamp, batch_id string",
    "scores": "run_id string, stream_id string, row_fingerprint string, detector string, "
    "score double, is_anomaly boolean, written_at timestamp, batch_id string",
}
# States: ``event_at`` is the time of the newest event in them.
STATE_SCHEMAS = {
    "streams": "stream_id string, name string, source_type string, config string, "
    "event_at timestamp, created_at timestamp",
    "run_events": "run_id string, stream_id string, run_type string, status string, "
    "event_at timestamp, started_at timestamp, finished_at timestamp, "
    "metadata map<string,struct<at:timestamp,value:string>>",
    "alert_versions": "alert_id string, dedupe_key string, run_id string, stream_id string, "
    "row_fingerprint string, observed_at timestamp, score double, detector string, "
    f"explanation {EXPLANATION}, event_at timestamp, created_at timestamp, batch_id string",
    "deletions": "stream_id string, event_at timestamp",
}
STATUSES = ("pending", "running", "completed", "failed")


def now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


class TableStore:
    """The tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = configure(spark)
        self.root = root.rstrip("/")
        self.membership = MembershipIndex(spark, f"{self.root}/observation_index")
        self.logs = {
            name: StateLog(spark, self.path(name), STATE_SCHEMAS[name], keys, merge)
            for name, keys, merge in (
                ("streams", ["stream_id"], lambda rows: merge_streams(self.live(rows))),
                ("run_events", ["run_id"], lambda rows: merge_runs(self.live(rows))),
                ("alert_versions", ["alert_id"], self._merge_finished_alerts),
                ("deletions", ["stream_id"], last_deletions),
            )
        }

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _stored(self, table: str) -> DataFrame:
        """The stored rows; an empty table when nothing was written yet."""
        schema = T.StructType.fromDDL(SCHEMAS[table])
        try:
            return self.spark.read.schema(schema).parquet(self.path(table))
        except Exception as error:  # the class depends on the client in use
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def read(self, table: str, among: Sequence[str] | None = None) -> DataFrame:
        """The rows of a table, or its states before they are merged, without deleted streams.

        ``among`` are buckets of streams (``log.buckets``); other states are not read.
        """
        if table in self.logs:
            return self.live(self.logs[table].states(among))
        return self.live(self._stored(table))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows written after their stream was last deleted, if it ever was."""
        if not self.logs["deletions"].parts():
            return rows
        gone = last_deletions(self.logs["deletions"].states()).select(
            F.col("stream_id").alias("gone_id"), F.col("event_at").alias("gone_at")
        )
        time = F.col("event_at" if "event_at" in rows.columns else "written_at")
        # Rows without a time are older than any record.
        early = time.isNull() | (time <= F.col("gone_at"))
        return rows.join(gone, (F.col("stream_id") == F.col("gone_id")) & early, "left_anti")

    def read_batches(self, table: str, batches: Sequence[str]) -> DataFrame:
        """The stored rows of named batches; no other directory is listed."""
        schema = T.StructType.fromDDL(SCHEMAS[table])
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path(table)}/batch_id={batch}" for batch in batches]
        reader = self.spark.read.schema(schema).option("basePath", self.path(table))
        return reader.parquet(*[path for path in paths if self._exists(path)] or [self.path(table)]).where(
            F.col("batch_id").isin(list(batches))
        )

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _fit(self, table: str, df: DataFrame) -> DataFrame:
        schema = T.StructType.fromDDL(SCHEMAS[table])
        return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])

    def write_batch(self, table: str, batch_id: str, df: DataFrame) -> DataFrame:
        """Write the rows of one batch, replacing what an earlier try left; returns the batch."""
        placed = df.withColumn("batch_id", F.lit(batch_id)).withColumn("written_at", F.lit(now()))
        fitted = self._fit(table, placed)
        target = f"{self.path(table)}/batch_id={batch_id}"
        fitted.drop("batch_id").write.mode("overwrite").parquet(target)
        return self.read_batches(table, [batch_id])

    # Streams

    def upsert_streams(
        self, names: DataFrame, source_type: str, config: Mapping[str, Any] | str
    ) -> DataFrame:
        """Add or re-configure the streams in ``names.name``; ids depend on the name alone."""
        text = config if isinstance(config, str) else json.dumps(config, sort_keys=True, default=str)
        rows = names.select(
            stream_id(F.col("name")).alias("stream_id"),
            "name",
            F.lit(source_type).alias("source_type"),
            F.lit(text).alias("config"),
            F.lit(now()).alias("event_at"),
        )
        written = self.logs["streams"].append(rows.withColumn("created_at", F.col("event_at")))
        return written.select("stream_id", "name")

    def streams(self) -> DataFrame:
        return latest_streams(self.read("streams"))

    # Runs

    def record_runs(
        self,
        runs: DataFrame,
        run_type: str,
        status: str,
        metadata: Mapping[str, Column | str | int],
    ) -> None:
        """Append one status event per row of ``runs`` (``run_id``, ``stream_id``)."""
        if status not in STATUSES:
            raise ValueError(f"unknown run status: {status}")
        entries: list[Column] = []
        for key, value in metadata.items():
            column = value if isinstance(value, Column) else F.lit(str(value))
            entries += [F.lit(key), column.cast("string")]
        events = runs.select(
            "run_id",
            "stream_id",
            F.lit(run_type).alias("run_type"),
            F.lit(status).alias("status"),
            F.lit(now()).alias("event_at"),
            F.create_map(*entries).alias("metadata"),
        )
        self.logs["run_events"].append(run_states(events))

    def runs(self, of: DataFrame | None = None) -> DataFrame:
        """The current state of every run, or of runs of the streams in ``of.stream_id`` and their like."""
        among = None if of is None else buckets(of)
        return shown_runs(merge_runs(self.read("run_events", among)))

    def completed_only(self, rows: DataFrame, among: Sequence[str] | None = None) -> DataFrame:
        """``rows`` but those of runs that failed or have not come to an end."""
        if not self.logs["run_events"].parts():
            return rows
        return without_unfinished(rows, self.read("run_events", among))

    def read_valid(self, table: str) -> DataFrame:
        """The stored rows of completed runs."""
        return self.completed_only(self.read(table))

    # Observations

    def append_observations(self, rows: DataFrame, batch_id: str) -> DataFrame:
        """Store rows whose (stream, fingerprint) is not stored yet; the first run keeps a row.

        Stored keys are read only from batches that may hold one of the new rows' keys, and in those
        only within the new rows' time range: fingerprints contain the time.
        """
        span = rows.agg(
            F.min("observed_at").alias("first"), F.max("observed_at").alias("last"),
            F.count(F.lit(1)).alias("n"),
        ).first()
        if span["n"] == 0:
            return self.write_batch("observations", batch_id, rows)
        if not self.membership.exists() and self._exists(self.path("observations")):
            self.membership.build(self._stored("observations"))
        held = self.membership.candidates(rows, span["first"], span["last"])
        self.membership.add(rows, batch_id, span["first"], span["last"], span["n"])
        batches = [batch for batch in held if batch != batch_id]
        stored = self.read_batches("observations", batches)
        if batches:
            stored = self.completed_only(self.live(stored), buckets(rows))
        fresh = new_observations(rows, stored, (span["first"], span["last"]))
        return self.write_batch("observations", batch_id, fresh)

    def observations(self) -> DataFrame:
        return self.read_valid("observations").drop("written_at")

    def scores(self) -> DataFrame:
        return self.read_valid("scores").drop("written_at")

    # Scores and alerts

    def append_scores(self, rows: DataFrame, batch_id: str) -> DataFrame:
        return self.write_batch("scores", batch_id, rows)

    def upsert_alerts(self, rows: DataFrame, batch_id: str) -> DataFrame:
        """Store a version of each alert; returns them with ``inserted``: no earlier version.

        Earlier versions are looked up among the states of the same streams.
        """
        versions = rows.withColumns({"event_at": F.lit(now()), "batch_id": F.lit(batch_id)})
        log = self.logs["alert_versions"]
        written = log.append(versions.withColumn("created_at", F.col("event_at")))
        among = buckets(written)
        earlier = self.read("alert_versions", among).where(F.col("batch_id") != batch_id)
        return mark_inserted(written.drop("created_at"), self.completed_only(earlier, among))

    def alerts(self) -> DataFrame:
        return latest_alerts(self.read_valid("alert_versions"))

    def _merge_finished_alerts(self, rows: DataFrame) -> DataFrame:
        """One version per alert of what completed runs found; others stay as they are.

        A version of a run that fails later must not have replaced the one before it.
        """
        rows = self.live(rows)
        done = self.completed_only(rows)
        columns = rows.columns
        versions = ["alert_id", "run_id", "event_at"]
        rest = rows.join(done.select(*versions), versions, "left_anti")
        return merge_alerts(done).select(*columns).unionByName(rest.select(*columns))

    # Maintenance

    def delete_stream(self, name: str) -> None:
        """Remove a stream with its runs, observations, scores and alerts; a record is all that is written.

        The stream may be stored anew afterwards.
        """
        gone = self.spark.range(1).select(F.sha2(F.lit(name), 256).alias("stream_id"))
        self.logs["deletions"].append(gone.withColumn("event_at", F.lit(now())))

    def purge(self, grace_seconds: float = GRACE_SECONDS) -> None:
        """Take what was deleted off the disk: compact the states, rewrite the batches concerned.

        The rows to keep are settled before their batches are replaced. Parts of logs stay for
        ``grace_seconds`` after they were merged. The records of deletion stay.
        """
        for log in self.logs.values():
            log.compact(everything=True, grace_seconds=grace_seconds)
        for table in SCHEMAS:
            rows = self._stored(table)
            dead = rows.join(self.live(rows).select("batch_id", "stream_id").distinct(),
                             ["batch_id", "stream_id"], "left_anti")
            touched = settle(dead.select("batch_id").distinct())
            kept = settle(self.live(rows.join(touched, "batch_id", "left_semi")))
            # Every task writes its own files of each batch: a large batch is not gathered in one task.
            (
                kept.write.mode("overwrite").partitionBy("batch_id")
                .option("partitionOverwriteMode", "dynamic").parquet(self.path(table))
            )
            # Only names of folders pass here, a few at a time.
            for row in touched.join(kept, "batch_id", "left_anti").toLocalIterator():
                path = self.spark._jvm.org.apache.hadoop.fs.Path(
                    f"{self.path(table)}/batch_id={row['batch_id']}"
                )
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def last_deletions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream_id").agg(F.max("event_at").alias("event_at"))


# The views below group by more than the id, by columns the id determines, so that a filter on
# those columns reaches the scan.


def without_unfinished(rows: DataFrame, states: DataFrame) -> DataFrame:
    """``rows`` but those of runs whose last status is not ``completed``."""
    keys = ["stream_id", "run_id"]
    last = states.groupBy(*keys).agg(F.max_by("status", "event_at").alias("status"))
    return rows.join(last.where(F.col("status") != "completed").select(*keys), keys, "left_anti").select(
        *rows.columns
    )


def merge_streams(states: DataFrame) -> DataFrame:
    current = F.max_by(F.struct("source_type", "config"), "event_at").alias("current")
    created = F.col("created_at") if "created_at" in states.columns else F.col("event_at")
    return (
        states.groupBy("stream_id", "name")
        .agg(current, F.max("event_at").alias("event_at"), F.min(created).alias("created_at"))
        .select("stream_id", "name", "current.*", "event_at", "created_at")
    )


def latest_streams(versions: DataFrame) -> DataFrame:
    """Current settings of each stream, with the times of its first and last version."""
    columns = ["stream_id", "name", "source_type", "config", "created_at"]
    return merge_streams(versions).select(*columns, F.col("event_at").alias("updated_at"))


def run_states(events: DataFrame) -> DataFrame:
    """Status events as states: every entry of the metadata has the time it was set."""
    done = F.col("status").isin("completed", "failed")
    dated = F.transform_values(
        "metadata", lambda _, value: F.struct(F.col("event_at").alias("at"), value.alias("value"))
    )
    return events.select(
        "run_id", "stream_id", "run_type", "status", "event_at", F.col("event_at").alias("started_at"),
        F.when(done, F.col("event_at")).alias("finished_at"), dated.alias("metadata"),
    )


def merge_runs(states: DataFrame) -> DataFrame:
    """One state per run: last status, start and finish, and the last value of each metadata entry.

    A run has a few states (one per change of status and retry), so they are merged in one group.
    """
    entries = F.flatten(F.collect_list(F.map_entries("metadata")))
    merged = (
        states.groupBy("run_id", "stream_id", "run_type")
        .agg(
            F.max_by("status", "event_at").alias("status"),
            F.max("event_at").alias("event_at"),
            F.min("started_at").alias("started_at"),
            F.max("finished_at").alias("finished_at"),
            entries.alias("entries"),
        )
        .withColumn("entries", F.sort_array("entries"))
    )
    # Sorted by key, then time: the last of each key counts.
    last = F.filter(
        "entries", lambda e, i: ~F.equal_null(F.get(F.col("entries"), i + 1)["key"], e["key"])
    )
    return merged.withColumn("metadata", F.map_from_entries(last)).drop("entries")


def shown_runs(states: DataFrame) -> DataFrame:
    plain = F.transform_values("metadata", lambda _, entry: entry["value"])
    return states.withColumn("metadata", plain).drop("event_at")


def latest_runs(events: DataFrame) -> DataFrame:
    """One row per run, from its status events."""
    return shown_runs(merge_runs(run_states(events)))


def merge_alerts(states: DataFrame) -> DataFrame:
    ids = [c for c in ("alert_id", "stream_id") if c in states.columns]
    columns = [c for c in states.columns if c not in (*ids, "created_at")]
    created = F.col("created_at") if "created_at" in states.columns else F.col("event_at")
    current = F.max_by(F.struct(*columns), F.struct("event_at", "run_id")).alias("current")
    return (
        states.groupBy(*ids)
        .agg(current, F.min(created).alias("created_at"))
        .select(*ids, "current.*", "created_at")
    )


def latest_alerts(versions: DataFrame) -> DataFrame:
    """Current version of each alert; ``created_at`` is that of its first version."""
    return merge_alerts(versions).drop("event_at")


def mark_inserted(versions: DataFrame, known: DataFrame) -> DataFrame:
    seen = known.select("dedupe_key").distinct().withColumn("seen", F.lit(True))
    return versions.join(seen, "dedupe_key", "left").withColumn(
        "inserted", F.col("seen").isNull()
    ).drop("seen")


def new_observations(
    rows: DataFrame, stored: DataFrame, span: tuple[dt.datetime, dt.datetime] | None = None
) -> DataFrame:
    """Rows with a (stream, fingerprint) that neither ``stored`` nor an earlier copy has.

    ``span`` is the first and the last time in ``rows``, if known.
    """
    keys = ["stream_id", "row_fingerprint"]
    span = span or rows.agg(F.min("observed_at"), F.max("observed_at")).first()
    if span[0] is None:
        return rows
    near = stored.where(F.col("observed_at").between(F.lit(span[0]), F.lit(span[1])))
    return rows.dropDuplicates(keys).join(near.select(*keys), keys, "left_anti")


def backfill_fingerprints(rows: DataFrame) -> DataFrame:
    """Give rows stored without a fingerprint the MD5 of stream, time and payload."""
    legacy = legacy_fingerprint(F.col("stream_id"), F.col("observed_at"), F.col("payload"))
    return rows.withColumn("row_fingerprint", F.coalesce(F.col("row_fingerprint"), legacy))


def duplicate_fingerprints(rows: DataFrame) -> DataFrame:
    """Keys stored more than once, with the number of copies."""
    counted = rows.groupBy("stream_id", "row_fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    return counted.where(F.col("copies") > 1)


def batch_key(runs: DataFrame) -> str:
    """One id for a set of runs, the same for the same set."""
    return runs.agg(content_digest(F.col("run_id"))).first()[0]


def series_names(names: Sequence[str], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in names], "name string")
