"""Micro-batch ingestion of JSON messages with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.config import DetectConfig, MessageSourceConfig
from tidewatch.plans.detect import detect
from tidewatch.plans.ingest import ingest_records
from tidewatch.session import settle
from tidewatch.sources.messages import offset_ranges, parse_messages, split_messages
from tidewatch.tables.store import TableStore, series_names


def consume_batch(
    store: TableStore,
    messages: DataFrame,
    config: MessageSourceConfig,
    on_invalid: Callable[[DataFrame], None] | None = None,
    dedupe_on: tuple[str, ...] = (),
) -> DataFrame | None:
    """Ingest one batch of messages; None when it is empty, and then no run is recorded.

    A bad message fails the batch unless ``on_invalid`` takes the bad ones. A batch that was stored
    before, offsets included, is skipped. ``dedupe_on`` lists columns (``observed_at``, ``value``)
    that identify a reading sent more than once; by default each offset is its own observation.
    """
    fields = config.timestamp_field, config.value_field
    if on_invalid is None:
        good = parse_messages(messages, *fields)
    else:
        good, bad = split_messages(messages, *fields)
        on_invalid(bad)
    if dedupe_on:
        good = good.groupBy(*dedupe_on).agg(
            F.min_by(F.struct(*good.columns), F.struct("topic", "partition", "offset")).alias("first")
        ).select("first.*")
    good = settle(good)
    if good.isEmpty():
        return None
    # One entry per topic and partition.
    offsets = offset_ranges(good).agg(F.to_json(F.sort_array(F.collect_list(F.struct("*"))))).first()[0]
    return ingest_records(
        store,
        good.withColumn("stream_name", F.lit(config.name)),
        config.source_type,
        config.as_json_dict(),
        {"topic": config.topic, "kafka_offsets": offsets},
        names=series_names([config.name], store.spark),
        with_offsets=True,
    )


def consume(
    store: TableStore,
    messages: DataFrame,
    config: MessageSourceConfig,
    checkpoint: str,
    detect_after: DetectConfig | None = None,
    on_result: Callable[[DataFrame], None] | None = None,
    on_alerts: Callable[[DataFrame], None] | None = None,
    on_invalid: Callable[[DataFrame], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start ingesting a streaming DataFrame of messages (see ``kafka_stream``).

    Spark commits the offsets of a batch after it was stored, so a batch may come again; it is then
    recognised by its content and skipped. With ``detect_after`` each batch that added rows is scored.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        result = consume_batch(store, batch, config, on_invalid)
        if result is None:
            return
        written = result.agg(F.sum("records_written")).first()[0]
        if on_result is not None:
            on_result(result)
        if detect_after is not None and written > 0:
            detect(store, detect_after, [config.name], on_alerts)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
