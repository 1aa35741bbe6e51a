"""Detection quality from labels and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classification_counts(
    df: DataFrame,
    label: str,
    flag: str,
    keys: Sequence[str] = (),
    totals: Sequence[Column] = (),
) -> DataFrame:
    """True positives, false positives and false negatives in one pass over labelled flags.

    ``totals`` are further aggregates to take in the same pass.
    """
    truth, found = F.col(label).cast("boolean"), F.col(flag).cast("boolean")
    return df.groupBy(*keys).agg(
        F.count_if(truth & found).alias("true_positives"),
        F.count_if(~truth & found).alias("false_positives"),
        F.count_if(truth & ~found).alias("false_negatives"),
        *totals,
    )


def set_counts(truth: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """The same counts from two sets of ids instead of two columns."""
    on = list(on)
    marked = (
        truth.select(*on)
        .distinct()
        .withColumn("label", F.lit(True))
        .join(found.select(*on).distinct().withColumn("flag", F.lit(True)), on, "full_outer")
        .withColumns(
            {
                "label": F.coalesce("label", F.lit(False)),
                "flag": F.coalesce("flag", F.lit(False)),
            }
        )
    )
    return classification_counts(marked, "label", "flag")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.try_divide(part, whole))


def precision_recall_f1(counts: DataFrame) -> DataFrame:
    """Add ``precision``, ``recall`` and ``f1``; each is zero where it is undefined."""
    hits = F.col("true_positives").cast("double")
    rated = counts.withColumns(
        {
            "precision": _ratio(hits, hits + F.col("false_positives")),
            "recall": _ratio(hits, hits + F.col("false_negatives")),
        }
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", _ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), both))


def false_positives_per_hour(false_positives: Column, hours: Column) -> Column:
    return F.when(hours <= 0, F.lit(0.0)).otherwise(F.try_divide(false_positives, hours))
