"""Embedding near-duplicates by an epsilon grid order join.

Boehm, Braunmueller, Krebs and Kriegel, "Epsilon Grid Order" (2001): unit vectors are sorted by the
cells of a grid on their leading principal dimensions, whose width is the distance that the least
cosine allows. The sequence is cut into intervals; pairs of intervals are refined level by level, and
those whose bounding boxes are provably too far apart are skipped. What is left are pairs of small
intervals, which tasks refine further in the same way and compare exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, table, travels_with_tasks
from tidewatch.llm.components import connected_components
from tidewatch.session import configure, settle

travels_with_tasks(__name__)

COSINE = 0.9
# Leading principal dimensions of the grid.
GRID = 8
# Vectors of an interval that a task reads whole; intervals joined per level; smallest interval.
INTERVAL = 2048
FAN_OUT = 8
LEAF = 256
# Box distances and dot products this close to a limit are decided by the exact cosine.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so nothing overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def principal_axes(vectors: DataFrame, width: int, axes: int = GRID) -> np.ndarray:
    """Leading principal axes of the unit vectors of ``vec``, from all of them.

    Each task adds up products of components; Spark sums them by row of the matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                rows = unit(_matrix(batch.column(0), width))
                total[:width] += rows.T @ rows
                total[width] += rows.sum(axis=0)
        names = ["i", *(f"c{j}" for j in range(width))]
        arrays = [pa.array(np.arange(width + 1, dtype=np.int64)), *map(pa.array, total.T.copy())]
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    columns = [f"c{j}" for j in range(width)]
    schema = "i long, " + ", ".join(f"{name} double" for name in columns)
    sums = vectors.select("vec").mapInArrow(run, schema).groupBy("i")
    rows = sums.agg(*(F.sum(name).alias(name) for name in columns)).collect()
    n = max(vectors.count(), 1)
    total = np.zeros((width + 1, width))
    for row in rows:
        total[row["i"]] = [row[name] for name in columns]
    mean = total[width] / n
    _, found = np.linalg.eigh(total[:width] / n - np.outer(mean, mean))
    return found[:, ::-1][:, :axes]


def near_blocks(
    lead_a: np.ndarray, lead_b: np.ndarray, same: bool, far: float
) -> Iterator[tuple[slice, slice]]:
    """Pairs of small intervals of two sequences whose boxes come within ``far`` of each other.

    With ``same``, both are one sequence and every pair of intervals comes once.
    """
    stack = [(0, len(lead_a), 0, len(lead_b))]
    while stack:
        i, j, k, m = stack.pop()
        if i >= j or k >= m or (same and m <= i):
            continue
        a, b = lead_a[i:j], lead_b[k:m]
        gap = np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0))
        gap = np.maximum(gap, 0.0)
        if math.sqrt(float(gap @ gap)) > far:
            continue
        if max(j - i, m - k) <= LEAF:
            yield slice(i, j), slice(k, m)
            continue
        half_a, half_b = (i + j) // 2, (k + m) // 2
        stack += [(x, y, u, v) for x, y in ((i, half_a), (half_a, j)) for u, v in ((k, half_b), (half_b, m))]


def linked_pairs(
    a: np.ndarray, b: np.ndarray, axes: np.ndarray, same: bool, cosine: float
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs of the two sequences whose cosine is at least ``cosine``."""
    far = math.sqrt(max(0.0, 2.0 - 2.0 * cosine)) + SLACK
    unit_a, unit_b = unit(a), unit(b)
    rows, columns = [], []
    for x, y in near_blocks(unit_a @ axes, unit_b @ axes, same, far):
        dots = unit_a[x] @ unit_b[y].T
        r, c = np.nonzero(dots >= cosine - SLACK)
        close = np.abs(dots[r, c] - cosine) <= SLACK
        r, c = r + x.start, c + y.start
        keep = r < c if same else np.ones(len(r), dtype=bool)
        for at in np.flatnonzero(close & keep):
            u, v = a[r[at]], b[c[at]]
            exact = math.fsum(u * v) / math.sqrt(math.fsum(u * u)) / math.sqrt(math.fsum(v * v))
            keep[at] = exact >= cosine
        rows.append(r[keep])
        columns.append(c[keep])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the smallest row that pairs ``a, b`` reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        lower = label.copy()
        np.minimum.at(lower, a, low)
        np.minimum.at(lower, b, low)
        lower = lower[lower]
        if np.array_equal(lower, label):
            return label
        label = lower


def _near_intervals(boxes: DataFrame, top: int, far: float) -> DataFrame:
    """Pairs ``i <= j`` of intervals whose boxes come within ``far``, refined from one root pair."""
    gap = " + ".join(
        f"power(greatest(0, a.low[{d}] - b.high[{d}], b.low[{d}] - a.high[{d}]), 2)"
        for d in range(GRID)
    )
    levels = [boxes]
    while top > 0:
        top //= FAN_OUT
        ends = [
            F.array(*(fold(F.col(side)[d]) for d in range(GRID))).alias(side)
            for side, fold in (("low", F.min), ("high", F.max))
        ]
        up = F.floor(F.col("id") / FAN_OUT).cast("long").alias("id")
        levels.append(settle(levels[-1].groupBy(up).agg(*ends)))
    pairs = levels[-1].select(F.col("id").alias("i"), F.col("id").alias("j"))
    for level in reversed(levels[:-1]):
        below = level.withColumn("up", F.floor(F.col("id") / FAN_OUT).cast("long"))
        finer = pairs.join(below.alias("a"), F.col("i") == F.col("a.up"))
        finer = finer.join(below.alias("b"), F.col("j") == F.col("b.up"))
        near = F.expr(f"a.id <= b.id and {gap} <= {far * far!r}D")
        chosen = finer.where(near)
        pairs = settle(chosen.select(F.col("a.id").alias("i"), F.col("b.id").alias("j")))
    return pairs


def embedding_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Number of links and component of every vector; a link is a cosine of at least ``cosine``.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Returns ``vec_id``,
    ``n_links`` (other rows linked directly), ``component_id`` (smallest id reachable) and ``kept``
    (the row is that id). Equal vectors are one class with a count, compared once. Vectors that are
    null, empty, zero, or hold null or non-finite components link with nothing, nor do rows with a
    null id, whose component is null. Shorter vectors count as filled up with zeros. Repeated rows
    are separate vectors with one id. No rows give no rows.
    """
    if not 0.0 < cosine <= 1.0:
        raise ValueError("cosine must be above 0 and at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    valid = rows.where(usable)
    classes = settle(valid.groupBy("vec").agg(F.min("vec_id").alias("cls"), F.count("*").alias("copies")))
    width = classes.agg(F.max(F.size("vec"))).first()[0] or 1
    axes = principal_axes(classes, width)
    if axes.shape[1] < GRID:
        axes = np.hstack([axes, np.zeros((width, GRID - axes.shape[1]))])
    far = math.sqrt(2.0 - 2.0 * cosine) + SLACK
    cell = max(far, 1e-6)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lead = unit(_matrix(batch.column(1), width)) @ axes
                flat = pa.ListArray.from_arrays(
                    np.arange(0, lead.size + 1, GRID, dtype=np.int32), pa.array(lead.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["cls", "lead"])

    leads = settle(classes.select("cls", "vec").mapInArrow(project, "cls long, lead array<double>"))
    order = [F.floor(F.col("lead")[d] / cell) for d in range(GRID)]
    placed = numbered(leads, [*order, F.col("cls")], "pos")
    placed = settle(placed.withColumn("id", F.floor(F.col("pos") / INTERVAL).cast("long")))
    ends = [
        F.array(*(fold(F.col("lead")[d]) for d in range(GRID))).alias(side)
        for side, fold in (("low", F.min), ("high", F.max))
    ]
    boxes = settle(placed.groupBy("id").agg(*ends))
    top = boxes.agg(F.max("id")).first()[0] or 0
    tiles = _near_intervals(boxes, top, far)

    sequence = settle(placed.select("cls", "pos", "id").join(classes, "cls"))
    first = sequence.join(tiles, F.col("id") == F.col("i")).withColumn("side", F.lit(0))
    second = sequence.join(tiles.where("i < j"), F.col("id") == F.col("j")).withColumn("side", F.lit(1))
    sides = first.union(second).select("i", "j", "side", "pos", "cls", "copies", "vec")

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks().sort_by([("side", "ascending"), ("pos", "ascending")])
        side, cls = tile["side"].to_numpy(), tile["cls"].to_numpy()
        copies = tile["copies"].to_numpy()
        matrix = _matrix(tile["vec"].combine_chunks(), width)
        n = int((side == 0).sum())
        same = n == len(side) and tile["i"][0].as_py() == tile["j"][0].as_py()
        other = matrix if same else matrix[n:]
        a, b = linked_pairs(matrix[:n], other, axes, same, cosine)
        if not same:
            b = b + n
        degree = np.bincount(a, weights=copies[b], minlength=len(cls))
        degree += np.bincount(b, weights=copies[a], minlength=len(cls))
        root = smallest_reachable(len(cls), a, b)
        hit = np.flatnonzero(degree)
        return pa.table({"cls": cls[hit], "links": degree[hit].astype(np.int64), "root": cls[root[hit]]})

    found = settle(sides.groupBy("i", "j").applyInArrow(compare, "cls long, links long, root long"))
    grouped = connected_components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    # A class is named by its smallest id, so the smallest class of a component names it.
    named = settle(
        classes.join(counted, "cls", "left")
        .join(grouped.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "vec",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "cls").alias("component_id"),
        )
    )
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = valid.join(named, "vec").select("vec_id", "n_links", "component_id")
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.union(alone).withColumn("kept", kept)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
