"""Isolation forest for every series at once.

Follows Liu, Ting and Zhou, "Isolation Forest" (2008): each tree isolates a small random subsample
with random cuts, and rows that need few cuts score as anomalous. Each tree draws its rows from all
fit rows by hash. Spark brings rows and forests together; the only Python is the tree itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import trees as _trees
from tidewatch.functions.scoring import min_max
from tidewatch.functions.trees import NODE_ARRAYS, Forest, grow_from_table, may_be_drawn
from tidewatch.operators.split import Series
from tidewatch.session import settle

# The tree code travels with the tasks: executors need not have this package installed.
cloudpickle.register_pickle_by_value(_trees)

# A forest is about a megabyte, so this many series can be shipped to every task.
BROADCAST_SERIES = 64
# Rows one task scores at a time when forests are joined to the rows instead.
ROWS_PER_GROUP = 500_000

_NODES = [
    T.StructField("tree", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("cut", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("path", T.ArrayType(T.LongType())),
    T.StructField("n", T.LongType()),
]


def with_draws(series: Series, seed: int) -> DataFrame:
    """Rows with ``drawn``, the hash that decides which trees take them: 60 bits of an MD5."""
    named = [F.col(c).cast("string") for c in (*series.keys, series.order[-1])]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *named))
    return series.rows.withColumn("drawn", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"))


def fit_candidates(series: Series, features: Sequence[str], seed: int) -> DataFrame:
    """Fit rows with ``drawn``; of a series longer than one task, those that some tree draws.

    Every fit row takes part in the draws of every tree, whatever the length of the series.
    """
    columns = [*series.keys, *features, "n", "drawn"]
    rows = with_draws(series, seed).where("is_fit").select(*columns)
    if series.compact:
        return rows

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn, n = (batch.column(name).to_numpy() for name in ("drawn", "n"))
            yield batch.filter(pa.array(may_be_drawn(drawn, n)))

    return rows.mapInArrow(keep, rows.schema)


def _in_own_tasks(df: DataFrame, series: Series) -> DataFrame:
    """Keep moderately many series from being put into one task for their small size: growing trees
    takes far longer than their bytes suggest."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if series.count <= 100 * tasks:
        return df.repartition(max(1, min(series.count, tasks)), *series.keys)
    return df


def fit_forest(series: Series, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Forests as one row of node arrays per series and tree."""
    keys, features = list(series.keys), list(dict.fromkeys(features))
    pool = fit_candidates(series, features, seed)
    key_fields = [pool.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *_NODES])

    def grow(table: pa.Table) -> pa.Table:
        trees = grow_from_table(table, keys, features, seed)
        count = len(trees)
        columns = {k: pa.repeat(table[k][0], count) for k in keys}
        columns["tree"] = pa.array(range(count), pa.int32())
        for name in NODE_ARRAYS:
            columns[name] = pa.array([tree[name] for tree in trees])
        columns["n"] = pa.repeat(table["n"][0], count)
        return pa.table(columns)

    return _in_own_tasks(pool, series).groupBy(*keys).applyInArrow(grow, schema)


def fit_and_score_forest(
    series: Series, features: Sequence[str], output: str, seed: int = 42
) -> DataFrame:
    """Grow and apply each forest in one call per series, without a table of forests in between.

    For series that fit one task. Gives the same scores as ``fit_forest`` and ``score_forest``.
    """
    keys, features = list(series.keys), list(dict.fromkeys(features))
    rows = with_draws(series, seed)
    kept = series.rows.columns
    schema = T.StructType([*series.rows.schema.fields, T.StructField(output, T.DoubleType())])

    def score(table: pa.Table) -> pa.Table:
        trees = grow_from_table(table.filter(table["is_fit"]), keys, features, seed)
        forest = Forest(trees, table["n"][0].as_py())
        points = np.column_stack([table[f].to_numpy().astype(np.float64) for f in features])
        scores = pa.array(forest.sample_scores(points), pa.float64())
        return table.select(kept).append_column(output, scores)

    return _in_own_tasks(rows, series).groupBy(*keys).applyInArrow(score, schema)


def score_forest(
    df: DataFrame, series: Series, forest: DataFrame, outputs: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Add sample scores (in [-1, 0), lower is more anomalous) to rows of ``series``.

    ``outputs`` maps each new column to the feature columns it scores.
    """
    keys = list(series.keys)
    if series.count <= BROADCAST_SERIES:
        return _score_with_broadcast(df, keys, forest, outputs)
    return _score_with_cogroup(df, keys, series.order[-1], forest, outputs)


def _score_with_broadcast(
    df: DataFrame, keys: list[str], forest: DataFrame, outputs: Mapping[str, Sequence[str]]
) -> DataFrame:
    """For at most ``BROADCAST_SERIES`` forests, which every task gets as Arrow tables."""
    # Unambiguous for any keys, null ones included.
    label = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    nodes = forest.select(label.alias("label"), *[f.name for f in _NODES]).toArrow()
    grouped = {
        name: nodes.filter(pc.equal(nodes["label"], name)).drop_columns(["label"])
        for name in nodes["label"].unique().to_pylist()
    }
    shipped = df.sparkSession.sparkContext.broadcast(grouped)

    @F.pandas_udf(T.DoubleType())
    def sample_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        ready: dict[str, Forest] = {}
        for labels, *columns in batches:
            points = np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])
            scores = np.empty(len(points))
            codes, names = pd.factorize(labels)
            for code, name in enumerate(names):
                if name not in ready:
                    ready[name] = Forest.from_table(shipped.value[name])
                mine = np.flatnonzero(codes == code)
                scores[mine] = ready[name].sample_scores(points[mine])
            yield pd.Series(scores)

    return df.withColumns(
        {
            output: sample_score(label, *[F.col(f) for f in features])
            for output, features in outputs.items()
        }
    )


def _score_with_cogroup(
    df: DataFrame,
    keys: list[str],
    row_id: str,
    forest: DataFrame,
    outputs: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Join rows and forests by series; a long series is cut into salted groups of bounded size."""
    salts = F.ceil(F.col("n") / ROWS_PER_GROUP)
    rows = df.withColumn("salt", F.pmod(F.xxhash64(F.col(row_id)), salts))
    trees = forest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    wanted = {output: list(features) for output, features in outputs.items()}
    kept = df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(o, T.DoubleType()) for o in wanted]])

    def score(group: pa.Table, nodes: pa.Table) -> pa.Table:
        group = group.select(kept)
        ready = Forest.from_table(nodes) if group.num_rows else None
        for output, features in wanted.items():
            scores = np.empty(0)
            if ready is not None:
                columns = [group[f].to_numpy().astype(np.float64) for f in features]
                scores = ready.sample_scores(np.column_stack(columns))
            group = group.append_column(output, pa.array(scores, pa.float64()))
        return group

    by = [*keys, "salt"]
    return rows.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(score, schema)


def with_contamination_offset(series: Series, score: str, contamination: float) -> Series:
    """Attach ``offset``: the linearly interpolated quantile of the fit scores."""
    n = F.col("n")
    position = (n - 1).cast("double") * F.lit(float(contamination))
    lower = F.floor(position)
    ranks = {"lower": lower, "upper": F.least(lower + 1, n - 1)}
    found = series.with_fit_ranks(score, ranks)
    step = (position - lower) * (F.col("upper") - F.col("lower"))
    rows = found.rows.withColumn("offset", F.col("lower") + step).drop("lower", "upper")
    return series.with_rows(rows)


@dataclass(frozen=True)
class ForestDetector:
    """Multivariate detector; flags rows beyond the ``contamination`` quantile of the fit scores."""

    name: str = "isolation_forest"
    feature_keys: tuple[str, ...] = ("value",)
    contamination: float = 0.05
    random_state: int = 42

    def fit(self, series: Series) -> DataFrame:
        """Settled forests, see ``fit_forest``."""
        return settle(fit_forest(series, self.feature_keys, self.random_state))

    def score(self, series: Series, model: DataFrame) -> DataFrame:
        """Add the detector's score, its score within the fit window and its flag."""
        sample = f"sample__{self.name}"
        # The Python scores are written once and read by the passes that follow.
        scored = settle(score_forest(series.rows, series, model, {sample: self.feature_keys}))
        return self._scaled(series.with_rows(scored))

    def fit_and_score(self, series: Series) -> tuple[DataFrame, DataFrame]:
        """Both at once while series fit one task; the model is then grown again only if used."""
        if not series.compact:
            model = self.fit(series)
            return self.score(series, model), model
        sample = f"sample__{self.name}"
        scored = fit_and_score_forest(series, self.feature_keys, sample, self.random_state)
        model = fit_forest(series, self.feature_keys, self.random_state)
        return self._scaled(series.with_rows(scored)), model

    def _scaled(self, series: Series) -> DataFrame:
        """The score is the anomaly score scaled to the batch at hand: all rows for ``score__``, the
        fit rows for ``fit_score__``."""
        sample = f"sample__{self.name}"
        offset = with_contamination_offset(series, sample, self.contamination)
        fit_only = F.when(F.col("is_fit"), F.col(sample))
        bounded = offset.with_aggregates(
            {
                "low": F.min(sample),
                "high": F.max(sample),
                "fit_low": F.min(fit_only),
                "fit_high": F.max(fit_only),
            }
        )
        # Scores are turned round so that higher means more anomalous.
        raw = -F.col(sample)
        return bounded.rows.withColumns(
            {
                f"score__{self.name}": min_max(raw, -F.col("high"), -F.col("low")),
                f"fit_score__{self.name}": min_max(raw, -F.col("fit_high"), -F.col("fit_low")),
                f"flag__{self.name}": F.col(sample) - F.col("offset") < 0,
            }
        ).drop("low", "high", "fit_low", "fit_high", "offset")
