"""Exact order statistics and ranks per key, safe when one key holds most of the rows.

``order_statistics`` answers "which row has rank r" without sorting the data: while a key has more
rows than one task should sort, the range that contains the rank is narrowed with approximate
quantiles and exact counts; only the few rows left in the range are sorted.

``ranked`` numbers every row. It needs one range-partitioned sort, which splits a large key over
many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewatch.session import settle

# A key with at most this many candidate rows is sorted inside one task.
SORTABLE_ROWS = 1_000_000
# Quantile grid and sketch accuracy of one narrowing pass: each pass keeps about 0.3% of the rows.
GRID = 1000
ACCURACY = 10_000


def percentile_rank(n: Column, percentile: float) -> Column:
    """Zero-based rank of the floor percentile: no interpolation, arithmetic in doubles."""
    if not 0.0 < percentile < 100.0:
        raise ValueError("percentile must be between 0 and 100 exclusive")
    position = (n - F.lit(1)).cast("double") * F.lit(float(percentile)) / F.lit(100.0)
    return F.floor(position).cast("bigint")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    targets: DataFrame,
    largest: int | None = None,
    sortable_rows: int | None = None,
) -> DataFrame:
    """Rows of the requested ranks.

    ``targets`` has the key columns, ``stat`` (a name), ``rank`` (zero-based) and ``n`` (rows of
    the key); it should derive from a settled table because it is scanned more than once. Rows that
    have null in the first ``order`` column have no rank, whatever the number of rows.
    ``largest`` is the largest ``n``, when the caller knows it. Returns the keys, ``stat`` and the
    ``order`` columns of the row that has that rank.
    """
    keys, order = list(keys), list(order)
    sortable_rows = SORTABLE_ROWS if sortable_rows is None else sortable_rows
    rows = df.select(*keys, *order).where(F.col(order[0]).isNotNull())
    if largest is None:
        largest = targets.agg(F.max("n")).first()[0]
    if largest is None or largest <= sortable_rows:
        return _by_sort(rows, keys, order, targets)
    small = targets.where(F.col("n") <= sortable_rows)
    hot = targets.where(F.col("n") > sortable_rows)
    small_rows = rows.join(small.select(*keys).distinct(), keys, "left_semi")
    return _by_sort(small_rows, keys, order, small).unionByName(
        _by_narrowing(rows, keys, order, hot, sortable_rows)
    )


def _by_sort(rows: DataFrame, keys: list[str], order: list[str], targets: DataFrame) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = rows.withColumn("rank", (F.row_number().over(window) - 1).cast("bigint"))
    return numbered.join(targets.select(*keys, "stat", "rank"), [*keys, "rank"]).select(
        *keys, "stat", *order
    )


def _inside(column: Column, low: str, high: str) -> Column:
    """``column`` lies in the open interval whose null ends mean unbounded."""
    return (F.col(low).isNull() | (column > F.col(low))) & (
        F.col(high).isNull() | (column < F.col(high))
    )


def _by_narrowing(
    rows: DataFrame, keys: list[str], order: list[str], targets: DataFrame, sortable_rows: int
) -> DataFrame:
    first, rest = order[0], order[1:]
    ids = [*keys, "stat"]
    if isinstance(rows.schema[first].dataType, StringType):
        # Hex digests: narrow on their leading 60 bits, which sort the same way.
        lead = f"{first}__lead"
        rows = rows.withColumn(lead, leading_bits(F.col(first)))
        found = _by_narrowing(rows, keys, [lead, *order], targets, sortable_rows)
        return found.drop(lead)

    value_type = rows.schema[first].dataType
    null = F.lit(None).cast(value_type)
    pending = targets.select(*ids, "rank", "n", null.alias("low"), null.alias("high"))
    done: list[DataFrame] = []

    while True:
        hot = pending.where(F.col("n") > sortable_rows)
        if hot.isEmpty():
            break
        done.append(pending.where(F.col("n") <= sortable_rows).withColumn("tied", F.lit(False)))
        split = settle(_split_interval(rows, keys, first, hot))
        done.append(split.where("tied"))
        pending = split.where(~F.col("tied")).drop("tied")

    done.append(pending.withColumn("tied", F.lit(False)))
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    settled = settle(settled)

    intervals = settled.where(~F.col("tied"))
    inside = rows.join(intervals.drop("tied"), keys).where(_inside(F.col(first), "low", "high"))
    window = Window.partitionBy(*ids).orderBy(*order)
    answers = (
        inside.withColumn("position", F.row_number().over(window) - 1)
        .where(F.col("position") == F.col("rank"))
        .select(*ids, *order)
    )
    ties = settled.where("tied")
    if not rest:
        return answers.unionByName(ties.select(*ids, F.col("low").alias(first)))
    if ties.isEmpty():
        return answers
    # Many rows share the value: the remaining order columns decide among them.
    tie_targets = ties.select(*keys, F.col("stat").alias("tie"), "stat", "rank", "n")
    tie_rows = rows.join(
        ties.select(*keys, F.col("stat").alias("tie"), F.col("low").alias("at")), keys
    ).where(F.col(first) == F.col("at"))
    tie_keys = [*keys, "tie"]
    among = order_statistics(
        tie_rows, tie_keys, rest, tie_targets, sortable_rows=sortable_rows
    )
    among = among.join(ties.select(*ids, F.col("low").alias(first)), ids)
    return answers.unionByName(among.select(*ids, *order))


def _split_interval(rows: DataFrame, keys: list[str], column: str, hot: DataFrame) -> DataFrame:
    """One narrowing pass: replace each interval by the part of it that contains the rank."""
    ids = [*keys, "stat"]
    value = F.col(column)
    inside = rows.join(hot, keys).where(_inside(value, "low", "high"))
    grid = F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)
    cuts = settle(inside.groupBy(*ids).agg(grid.alias("grid")))

    slot = F.floor(F.col("rank") / F.greatest(F.col("n") - 1, F.lit(1)) * GRID).cast("int")
    bracket = hot.join(cuts, ids).select(
        *ids,
        "rank",
        "n",
        "low",
        "high",
        F.element_at("grid", F.greatest(slot, F.lit(1))).alias("a"),
        F.element_at("grid", F.least(slot + 3, F.lit(GRID + 1))).alias("b"),
    )
    bracket = settle(bracket)

    counted = (
        rows.join(bracket, keys)
        .where(_inside(value, "low", "high"))
        .groupBy(*ids)
        .agg(
            F.count_if(value < F.col("a")).alias("below"),
            F.count_if(value == F.col("a")).alias("at_a"),
            F.count_if((value > F.col("a")) & (value < F.col("b"))).alias("between"),
            F.count_if((value == F.col("b")) & (F.col("b") > F.col("a"))).alias("at_b"),
            F.count_if(value > F.col("b")).alias("above"),
        )
    )
    # The five parts in order: open below a, exactly a, open (a, b), exactly b, open above b.
    part = "struct<low:{t},high:{t},tied:boolean,size:bigint>".format(
        t=rows.schema[column].dataType.simpleString()
    )

    def piece(low: str, high: str, tied: bool, size: str) -> Column:
        return F.struct(
            F.col(low).alias("low"),
            F.col(high).alias("high"),
            F.lit(tied).alias("tied"),
            F.col(size).alias("size"),
        ).cast(part)

    pieces = F.array(
        piece("low", "a", False, "below"),
        piece("a", "a", True, "at_a"),
        piece("a", "b", False, "between"),
        piece("b", "b", True, "at_b"),
        piece("b", "high", False, "above"),
    )
    offset = (
        F.when(F.col("pos") == 0, F.lit(0))
        .when(F.col("pos") == 1, F.col("below"))
        .when(F.col("pos") == 2, F.col("below") + F.col("at_a"))
        .when(F.col("pos") == 3, F.col("below") + F.col("at_a") + F.col("between"))
        .otherwise(F.col("below") + F.col("at_a") + F.col("between") + F.col("at_b"))
    )
    return (
        bracket.join(counted, ids)
        .select("*", F.posexplode(pieces).alias("pos", "piece"))
        .withColumn("offset", offset)
        .where((F.col("rank") >= F.col("offset")) & (F.col("rank") < F.col("offset") + F.col("piece.size")))
        .select(
            *ids,
            (F.col("rank") - F.col("offset")).alias("rank"),
            F.col("piece.size").alias("n"),
            F.col("piece.low").alias("low"),
            F.col("piece.high").alias("high"),
            F.col("piece.tied").alias("tied"),
        )
    )


def leading_bits(hex_digest: Column) -> Column:
    """The first 60 bits of a hex digest as a bigint."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("bigint")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``rank`` (zero-based within the key) and ``n`` (rows of the key).

    ``order`` must be a total order. The sort is range partitioned on keys and order, so a large
    key spans many tasks; the running totals over its pieces involve one row per key and task.
    """
    keys, order = list(keys), list(order)
    position = F.monotonically_increasing_id()
    placed = settle(df.orderBy(*keys, *order).withColumn("place", position))
    piece = F.shiftright("place", 33).alias("piece")
    pieces = (
        placed.groupBy(*keys, piece)
        .agg(F.min("place").alias("head"), F.count(F.lit(1)).alias("size"))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("size").over(
                    Window.partitionBy(*keys).orderBy("piece").rowsBetween(
                        Window.unboundedPreceding, -1
                    )
                ),
                F.lit(0),
            ),
        )
        .withColumn("n", F.sum("size").over(Window.partitionBy(*keys)))
        .drop("size")
    )
    pieces = settle(pieces)
    return (
        placed.withColumn("piece", piece)
        .join(pieces, [*keys, "piece"])
        .withColumn("rank", F.col("place") - F.col("head") + F.col("before"))
        .drop("place", "piece", "head", "before")
    )
