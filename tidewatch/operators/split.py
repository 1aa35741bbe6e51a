"""Series with a fit window, and statistics of a series attached to its rows.

There are two ways to attach. While every series is short enough to be sorted in one task, window
functions over the series key do it: all statistics of all detectors then share a single shuffle.
As soon as one series is longer, statistics are computed as small tables by ``order_statistics`` and
plain aggregation, which spread a long series over all tasks, and are joined to the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators import order_stats
from tidewatch.operators.order_stats import order_statistics
from tidewatch.session import settle

# Fewest observations a series needs, and fewest rows it is fitted on.
MIN_ROWS = 10


def _sortable(rows: int | None) -> int:
    return order_stats.SORTABLE_ROWS if rows is None else rows


def series_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count ``n`` per series."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def too_short(sizes: DataFrame) -> DataFrame:
    """Series with fewer observations than detection needs."""
    return sizes.where(F.col("n") < MIN_ROWS)


def fit_count(n: Column, fit_ratio: float) -> Column:
    """Rows of the fit window; the product is taken in doubles and truncated."""
    wanted = F.floor(n.cast("double") * F.lit(float(fit_ratio))).cast("bigint")
    return F.least(F.greatest(wanted, F.lit(MIN_ROWS)), n - 1)


def rank_targets(sizes: DataFrame, keys: Sequence[str], ranks: Mapping[str, Column]) -> DataFrame:
    """Targets for ``order_statistics``; rank expressions may use the column ``n``."""
    wanted = F.array(
        *[
            F.struct(F.lit(stat).alias("stat"), rank.cast("bigint").alias("rank"))
            for stat, rank in ranks.items()
        ]
    )
    return sizes.select(*keys, "n", F.explode(wanted).alias("t")).select(*keys, "n", "t.*")


@dataclass(frozen=True)
class Series:
    """Rows of many series: every row has ``is_fit`` and ``n``, the rows of its fit window."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    count: int
    largest: int
    sortable_rows: int | None = None

    @property
    def compact(self) -> bool:
        """Every series can be sorted in one task."""
        return self.largest <= _sortable(self.sortable_rows)

    @property
    def fit_rows(self) -> DataFrame:
        return self.rows.where("is_fit")

    def with_rows(self, rows: DataFrame) -> Series:
        return replace(self, rows=rows)

    def with_aggregates(self, aggregates: Mapping[str, Column]) -> Series:
        """Attach aggregates over all rows of the series as columns."""
        if self.compact:
            whole = Window.partitionBy(*self.keys)
            return self.with_rows(
                self.rows.withColumns({name: a.over(whole) for name, a in aggregates.items()})
            )
        named = [aggregate.alias(name) for name, aggregate in aggregates.items()]
        return self._joined(self.rows.groupBy(*self.keys).agg(*named))

    def with_fit_ranks(self, value: str, ranks: Mapping[str, Column]) -> Series:
        """Attach the values that have the given ranks among the fit rows.

        Null values have no rank. Rank expressions may use ``n``, here the fit rows whose value is not
        null; without any, results are null. Each result column is named after its rank.
        """
        if self.compact:
            among = Window.partitionBy(*self.keys, "is_fit").orderBy(F.col(value).asc_nulls_last())
            ranked = F.count(F.when(F.col("is_fit"), F.col(value)))
            placed = self.with_rows(
                self.rows.withColumn("place", (F.row_number().over(among) - 1).cast("bigint"))
                .withColumn("n_rows", F.col("n"))
                .withColumn("n", ranked.over(Window.partitionBy(*self.keys)))
            )
            picked = {
                name: F.max(F.when(F.col("is_fit") & (F.col("place") == rank), F.col(value)))
                for name, rank in ranks.items()
            }
            attached = placed.with_aggregates(picked)
            rows = attached.rows.withColumn("n", F.col("n_rows")).drop("place", "n_rows")
            return attached.with_rows(rows)
        sizes = settle(self.fit_rows.groupBy(*self.keys).agg(F.count(value).alias("n")))
        targets = rank_targets(sizes, self.keys, ranks)
        found = order_statistics(
            self.fit_rows, self.keys, [value], targets, self.largest, self.sortable_rows
        )
        wide = found.groupBy(*self.keys).agg(
            *[F.max(F.when(F.col("stat") == name, F.col(value))).alias(name) for name in ranks]
        )
        return self._joined(wide, "left")

    def _joined(self, table: DataFrame, how: str = "inner") -> Series:
        return self.with_rows(self.rows.join(settle(table), list(self.keys), how))


def whole_series(df: DataFrame, keys: Sequence[str]) -> Series:
    """Series whose fit window is everything."""
    sizes = series_sizes(df, keys)
    count, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    if (largest or 0) <= order_stats.SORTABLE_ROWS:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        rows = df.withColumn("n", n).withColumn("is_fit", F.lit(True))
        return Series(rows, tuple(keys), (), count, largest or 0)
    sizes = settle(sizes)
    # ``n`` is replaced, as in the compact case.
    rows = df.drop("n").join(sizes, list(keys)).withColumn("is_fit", F.lit(True))
    return Series(rows, tuple(keys), (), count, largest)


def fit_splits(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fit_ratio: float = 0.8
) -> list[Series]:
    """Fit windows of short and of long series apart, so that one long series does not change how
    all others are handled. Gives one or two ``Series``; results are the union over them."""
    keys = list(keys)
    sizes = series_sizes(df, keys).where(F.col("n") >= MIN_ROWS)
    is_long = F.col("n") > order_stats.SORTABLE_ROWS
    long, count = sizes.agg(F.count_if(is_long), F.count(F.lit(1))).first()
    if long in (0, count):
        return [fit_split(df, keys, order, fit_ratio)]
    # At most one key per SORTABLE_ROWS rows.
    long_keys = settle(sizes.where(is_long).select(*keys))
    return [
        fit_split(df.join(long_keys, keys, how), keys, order, fit_ratio)
        for how in ("left_anti", "left_semi")
    ]


def fit_split(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fit_ratio: float = 0.8,
    sortable_rows: int | None = None,
) -> Series:
    """Mark the earliest rows of each series as its fit window.

    ``order`` is time first and a unique column last. Series that are too short are left out; use
    ``too_short(series_sizes(...))`` to report them. A series with more than ``sortable_rows`` rows
    (``order_stats.SORTABLE_ROWS`` if none) is not sorted in one task; results do not depend on it.
    """
    keys, order = list(keys), list(order)
    sizes = series_sizes(df, keys).where(F.col("n") >= MIN_ROWS)
    count, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    shape = tuple(keys), tuple(order), count, largest or 0
    if (largest or 0) <= _sortable(sortable_rows):
        whole = Window.partitionBy(*keys)
        rows = (
            df.withColumn("place", F.row_number().over(whole.orderBy(*order)) - 1)
            .withColumn("n", F.count(F.lit(1)).over(whole))
            .where(F.col("n") >= MIN_ROWS)
            .withColumn("n", fit_count(F.col("n"), fit_ratio))
            .withColumn("is_fit", F.col("place") < F.col("n"))
            .drop("place")
        )
        return Series(rows, *shape, sortable_rows=sortable_rows)
    # Only the row at the edge of each fit window is looked up; the data itself is not sorted.
    # Rows without a time come first and have no rank.
    untimed = F.count_if(F.col(order[0]).isNull()).alias("untimed")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), untimed)
    sizes = settle(sizes.where(F.col("n") >= MIN_ROWS))
    fitted = fit_count(F.col("n"), fit_ratio)
    edge = F.greatest(fitted - F.col("untimed"), F.lit(0))
    targets = rank_targets(sizes, keys, {"edge": edge})
    here = F.struct(*[F.col(c).alias(c) for c in order])
    edges = order_statistics(df, keys, order, targets, largest, sortable_rows)
    edges = edges.select(*keys, here.alias("edge"))
    edges = settle(edges.join(sizes.select(*keys, fitted.alias("n")), keys))
    # ``n`` becomes the fit rows, as in the compact case: a column ``n`` of ``df`` is replaced.
    rows = df.drop("n").join(edges, keys).withColumn("is_fit", here < F.col("edge")).drop("edge")
    return Series(rows, *shape, sortable_rows)
