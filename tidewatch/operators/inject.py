"""Synthetic series and injected anomalies, reproducible on any partitioning.

Every draw is a hash of the seed and the row it belongs to. Injections read the untouched series, so
they do not depend on the order in which they are made.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.hashing import gaussian, uniform, uniform_between
from tidewatch.operators.order_stats import order_statistics
from tidewatch.operators.split import rank_targets
from tidewatch.session import settle

# Reach and decay of a drift, and rows of context before a contextual anomaly.
DRIFT_ROWS = 5
DRIFT_DECAY = 0.3
CONTEXT_ROWS = 5
KINDS = ("point", "contextual", "drift")


def baseline_value(index: Column, base: float, seed: int, *series: Column) -> Column:
    """``base + sin(index / 25)`` plus normal noise with deviation 0.5."""
    noise = gaussian(seed, *series, index) * F.lit(0.5)
    return F.lit(float(base)) + F.sin(index / F.lit(25.0)) + noise


def sample_value(index: Column, seed: int, *series: Column) -> Column:
    """A saw tooth of 50 steps from 20 to 24.9 plus normal noise with deviation 0.2."""
    return F.lit(20.0) + (index % 50) * F.lit(0.1) + gaussian(seed, *series, index) * F.lit(0.2)


def baseline_series(spark: SparkSession, n: int, base: float = 20.0, seed: int = 42) -> DataFrame:
    """``idx`` and ``value`` of one synthetic series."""
    return spark.range(n).select(
        F.col("id").alias("idx"), baseline_value(F.col("id"), base, seed).alias("value")
    )


def pool_bounds(n: Column) -> tuple[Column, Column]:
    """Injections stay clear of the first and last tenth of a series."""
    start = F.greatest(F.lit(10), F.floor(n * F.lit(0.1)))
    return start, F.greatest(start + 1, F.floor(n * F.lit(0.9)))


def in_pool(index: Column, n: Column) -> Column:
    start, end = pool_bounds(n)
    return (index >= start) & (index < end)


def select_indices(
    rows: DataFrame, keys: Sequence[str], n_anomalies: int, seed: int
) -> DataFrame:
    """``n_anomalies`` distinct indices of each series, drawn from its pool.

    Asking for more than the pool holds is an error.

    ``rows`` has the keys, ``idx`` and the series length ``n``. The cut-off draw is found as an order
    statistic, so a long series is neither sorted nor gathered.
    """
    keys = list(keys)
    start, end = pool_bounds(F.col("n"))
    too_many = F.raise_error(F.lit("more anomalies than places in the middle of the series"))
    fits = F.when(F.lit(n_anomalies) <= F.least(end, F.col("n")) - start, True)
    fits = fits.otherwise(too_many.cast("boolean"))
    drawn = rows.where(fits & in_pool(F.col("idx"), F.col("n"))).select(
        *keys, "idx", uniform(seed, "pick", *[F.col(k) for k in keys], F.col("idx")).alias("pick")
    )
    return _smallest_draws(drawn, keys, n_anomalies)


def _smallest_draws(drawn: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """``idx`` of the rows of each series with the ``count`` smallest draws ``pick``."""
    pools = settle(drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    last = F.least(F.lit(count), F.col("n")) - 1
    cutoffs = order_statistics(drawn, keys, ["pick", "idx"], rank_targets(pools, keys, {"cut": last}))
    cutoffs = cutoffs.select(*keys, F.struct("pick", "idx").alias("cutoff"))
    return (
        drawn.join(cutoffs, keys)
        .where(F.struct("pick", "idx") <= F.col("cutoff"))
        .select(*keys, "idx")
    )


def mark_rows(
    rows: DataFrame, keys: Sequence[str], count: int, seed: int, purpose: str, mark: str
) -> DataFrame:
    """Add the boolean ``mark``, true for exactly ``count`` rows of each series, drawn from all of them.

    ``rows`` has the keys and ``idx``. In a series with fewer rows all are marked.
    """
    if count <= 0:
        return rows.withColumn(mark, F.lit(False))
    keys = list(keys)
    pick = uniform(seed, purpose, *[F.col(k) for k in keys], F.col("idx")).alias("pick")
    drawn = rows.select(*keys, "idx", pick)
    marked = settle(_smallest_draws(drawn, keys, count)).withColumn(mark, F.lit(True))
    return rows.join(marked, [*keys, "idx"], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def sample_series(
    rows: DataFrame, keys: Sequence[str], n_spikes: int, seed: int = 42, interval_seconds: int = 60
) -> DataFrame:
    """Sample series of any length: add ``observed_at``, ``value`` and ``spike``.

    A saw tooth with jitter, one reading each interval from the start of 2024, and exactly ``n_spikes``
    readings per series that lie 30 to 50 higher. ``rows`` has the keys and ``idx`` (0-based).
    """
    ids = [F.col(k) for k in [*keys, "idx"]]
    marked = mark_rows(rows, keys, n_spikes, seed, "spike", "spike")
    height = F.when(F.col("spike"), uniform_between(30, 50, seed, "height", *ids)).otherwise(F.lit(0.0))
    value = sample_value(F.col("idx"), seed, *ids[:-1]) + height
    start = F.unix_micros(F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))
    moment = F.timestamp_micros(start + F.col("idx") * F.lit(interval_seconds * 1_000_000))
    return marked.withColumns({"observed_at": moment, "value": value})


def labelled_records(rows: DataFrame, keys: Sequence[str], n_anomalies: int, seed: int = 42) -> DataFrame:
    """Records to test detectors with: add ``value`` and ``label``.

    Values are normal around 20 with deviation 0.5; exactly ``n_anomalies`` per series are moved up or
    down by 20 to 40 and labelled. ``rows`` has the keys and ``idx`` (0-based).
    """
    ids = [F.col(k) for k in [*keys, "idx"]]
    marked = mark_rows(rows, keys, n_anomalies, seed, "label", "label")
    usual = F.lit(20.0) + gaussian(seed, *ids) * F.lit(0.5)
    return marked.withColumn(
        "value", F.when(F.col("label"), point_value(usual, seed, *ids)).otherwise(usual)
    )


def choose_kind(kinds: Sequence[str], seed: int, *ids: Column) -> Column:
    slot = F.floor(uniform(seed, "kind", *ids) * len(kinds)) + 1
    return F.element_at(F.array(*[F.lit(k) for k in kinds]), slot.cast("int"))


def point_value(value: Column, seed: int, *ids: Column) -> Column:
    """The value moved up or down by 20 to 40."""
    sign = F.when(uniform(seed, "sign", *ids) < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    return value + sign * uniform_between(20, 40, seed, "point", *ids)


def contextual_value(context: Column, seed: int, *ids: Column) -> Column:
    """The mean of the values just before, raised by 8 to 15."""
    return context + uniform_between(8, 15, seed, "contextual", *ids)


def drift_shift(offset: Column, seed: int, *ids: Column) -> Column:
    """A rise of 5 to 10 that decays over the rows that follow."""
    return uniform_between(5, 10, seed, "drift", *ids) * F.exp(F.lit(-DRIFT_DECAY) * offset)


def local_means(rows: DataFrame, keys: Sequence[str], at: DataFrame) -> DataFrame:
    """Mean of up to five values before each chosen index; null at the start of a series.

    Looks up the neighbours of the chosen rows only: no window over the whole series. The values are
    added in time order, so that the mean is the same to the last bit on any partitioning.
    """
    near = at.select(
        *keys,
        F.col("idx").alias("center"),
        F.explode(F.sequence(F.col("idx") - CONTEXT_ROWS, F.col("idx") - 1)).alias("idx"),
    )
    found = (
        near.join(rows.select(*keys, "idx", "value"), [*keys, "idx"])
        .groupBy(*keys, "center")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "value")))["value"].alias("values"))
    )
    total = F.aggregate("values", F.lit(0.0), lambda so_far, value: so_far + value)
    return found.select(
        *keys, F.col("center").alias("idx"), (total / F.size("values")).alias("context")
    )


def inject(
    rows: DataFrame,
    keys: Sequence[str],
    n_anomalies: int,
    kinds: Sequence[str] = KINDS,
    seed: int = 42,
) -> DataFrame:
    """Rows with injected anomalies: ``value`` is changed, ``label`` marks the ground truth and
    ``kind`` names the anomaly placed at the row (null elsewhere).

    ``rows`` has the keys, ``idx`` (0-based), the series length ``n`` and ``value``.
    """
    keys = list(keys)
    if n_anomalies <= 0:
        return rows.withColumns({"label": F.lit(False), "kind": F.lit(None).cast("string")})
    unknown = set(kinds) - set(KINDS)
    if unknown or not kinds:
        raise ValueError(f"unknown anomaly kinds: {sorted(unknown)}")
    ids = [F.col(k) for k in [*keys, "idx"]]
    chosen = settle(
        select_indices(rows, keys, n_anomalies, seed).withColumn("kind", choose_kind(kinds, seed, *ids))
    )
    context = local_means(rows, keys, chosen.where(F.col("kind") == "contextual"))
    drifts = (
        chosen.where(F.col("kind") == "drift")
        .withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(DRIFT_ROWS - 1))))
        .withColumn("shift", drift_shift(F.col("offset"), seed, *ids))
        .withColumn("idx", F.col("idx") + F.col("offset"))
        .groupBy(*keys, "idx")
        .agg(F.sum("shift").alias("shift"))
    )
    changes = settle(
        chosen.join(context, [*keys, "idx"], "left").join(drifts, [*keys, "idx"], "full_outer")
    )
    value = F.col("value")
    replaced = (
        F.when(F.col("kind") == "point", point_value(value, seed, *ids))
        .when(
            F.col("kind") == "contextual",
            contextual_value(F.coalesce("context", value), seed, *ids),
        )
        .otherwise(value)
    )
    # A contextual anomaly replaces the value, together with what an earlier drift has added to it.
    keeps_shift = F.coalesce(F.col("kind") != "contextual", F.lit(True)) & F.col("shift").isNotNull()
    shift = F.when(keeps_shift, F.col("shift")).otherwise(F.lit(0.0))
    touched = F.col("kind").isNotNull() | F.col("shift").isNotNull()
    return (
        rows.join(changes, [*keys, "idx"], "left")
        .withColumn("label", touched)
        .withColumn("value", replaced + shift)
        .drop("context", "shift")
    )


def retail_sample(days: DataFrame, day: str = "day") -> DataFrame:
    """Invoice lines for each day number (from 0): a weekly rhythm and one spike on day 90."""
    number, line = F.col(day), F.col("line")
    spiked = (number == 90) & (line < 3)
    quantity = (1 + (number + line) % 5) * F.when(spiked, F.lit(25)).otherwise(F.lit(1))
    price = F.round(F.lit(2.5) + ((number + line) % 10) * F.lit(0.35), 2)
    return (
        days.withColumn("lines", F.lit(20) + (number % 7) * 3)
        .withColumn("line", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("lines") - 1).cast("bigint"))))
        .withColumn("Quantity", quantity.cast("double"))
        .withColumn("UnitPrice", price)
        .withColumn("StockCode", F.concat(F.lit("S"), (F.lit(1000) + line).cast("string")))
        .withColumn(
            "InvoiceDate",
            F.timestamp_seconds(F.lit(1293840000) + number * 86400 + line * 420),
        )
        .select("InvoiceDate", "Quantity", "UnitPrice", "StockCode")
    )
