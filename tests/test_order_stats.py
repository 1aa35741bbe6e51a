from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import order_stats
from tidewatch.operators.order_stats import order_statistics, percentile_rank, ranked
from tidewatch.operators.mad import with_mad
from tidewatch.operators.split import fit_split, rank_targets
from tidewatch.session import settle


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, a value that a third of its rows share, and short keys."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        value = 7.0 if rng.random() < 0.34 else round(rng.lognormvariate(0, 2), 3)
        rows.append(("hot" if i % 10 else f"k{i % 70}", i, value))
    frame = settle(spark.createDataFrame(rows, "key string, id bigint, value double"))
    return frame, rows


def expected(rows, ranks):
    by_key: dict[str, list[tuple[float, int]]] = {}
    for key, i, value in rows:
        by_key.setdefault(key, []).append((value, i))
    out = {}
    for key, pairs in by_key.items():
        pairs.sort()
        for stat, place in ranks.items():
            out[key, stat] = pairs[place(len(pairs))]
    return out


RANKS = {
    "first": lambda n: 0,
    "third": lambda n: (n - 1) // 3,
    "middle": lambda n: (n - 1) // 2,
    "high": lambda n: int((n - 1) * 95.0 / 100.0),
    "last": lambda n: n - 1,
}


@pytest.mark.parametrize("sortable", [10, 300, 10_000_000])
@pytest.mark.parametrize("order", [["value"], ["value", "id"]])
def test_any_rank_of_a_skewed_key(skewed, sortable, order):
    frame, rows = skewed
    n = F.col("n")
    sizes = settle(frame.groupBy("key").agg(F.count("*").alias("n")))
    targets = rank_targets(
        sizes,
        ["key"],
        {
            "first": F.lit(0),
            "third": F.floor((n - 1) / 3),
            "middle": F.floor((n - 1) / 2),
            "high": percentile_rank(n, 95.0),
            "last": n - 1,
        },
    )
    found = order_statistics(frame, ["key"], order, targets, sortable_rows=sortable).collect()
    got = {(r["key"], r["stat"]): tuple(r[c] for c in order) for r in found}
    want = {k: v[: len(order)] for k, v in expected(rows, RANKS).items()}
    assert len(found) == len(want)
    assert got == want


def test_hex_digests_break_ties(spark):
    rows = settle(
        spark.range(2000).select(
            F.lit("a").alias("key"), F.lit(1.0).alias("value"), F.sha2(F.col("id").cast("string"), 256).alias("fp")
        )
    )
    sizes = settle(rows.groupBy("key").agg(F.count("*").alias("n")))
    targets = rank_targets(sizes, ["key"], {"x": F.lit(777)})
    found = order_statistics(rows, ["key"], ["value", "fp"], targets, sortable_rows=100).first()
    assert found["fp"] == sorted(r["fp"] for r in rows.collect())[777]


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_ranks_do_not_depend_on_partitions(spark, skewed, partitions):
    frame, rows = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = ranked(frame.repartition(partitions), ["key"], ["value", "id"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    by_key: dict[str, list] = {}
    for key, i, value in rows:
        by_key.setdefault(key, []).append((value, i))
    want = {}
    for key, pairs in by_key.items():
        for place, (_, i) in enumerate(sorted(pairs)):
            want[i] = (place, len(pairs))
    assert {r["id"]: (r["rank"], r["n"]) for r in out} == want


def test_floor_percentile_does_not_interpolate(spark):
    frame = spark.createDataFrame([("s", float(v)) for v in range(1, 11)], "key string, value double")
    sizes = settle(frame.groupBy("key").agg(F.count("*").alias("n")))
    for p, want in ((90.0, 9.0), (95.0, 9.0), (50.0, 5.0)):
        targets = rank_targets(sizes, ["key"], {"p": percentile_rank(F.col("n"), p)})
        assert order_statistics(frame, ["key"], ["value"], targets).first()["value"] == want


@pytest.mark.parametrize("p", [0.0, 100.0, -1.0])
def test_percentile_bounds(p):
    with pytest.raises(ValueError):
        percentile_rank(F.col("n"), p)


def test_short_keys_are_sorted_in_one_task_only_while_short():
    assert order_stats.SORTABLE_ROWS <= 1_000_000


@pytest.mark.parametrize("sortable", [10, 1_000_000])
def test_nulls_have_no_rank_in_short_and_long_series(spark, sortable):
    """Median and MAD of the values there are; a series of nulls keeps its rows, with null statistics."""
    values = {"mixed": [None if i % 3 == 0 else float(i * 7 % 320) for i in range(320)], "empty": [None] * 40}
    rows = [(key, i, v) for key, own in values.items() for i, v in enumerate(own)]
    frame = settle(spark.createDataFrame(rows, "key string, id bigint, value double"))
    series = fit_split(frame, ["key"], ["id"], sortable_rows=sortable)
    assert series.compact == (sortable > 320)
    out = with_mad(series, "value", "model").rows.collect()
    assert len(out) == 360 and {r["key"]: r["n"] for r in out} == {"mixed": 256, "empty": 32}
    known = sorted(v for v in values["mixed"][:256] if v is not None)
    middle = lambda x: (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
    median = middle(known)
    mad = middle(sorted(abs(v - median) for v in known))
    found = {r["key"]: r["model"] for r in out}
    assert (found["mixed"]["median"], found["mixed"]["mad"]) == (median, mad)
    assert found["mixed"]["threshold"] is not None
    assert found["empty"]["median"] is None and found["empty"]["threshold"] is None
