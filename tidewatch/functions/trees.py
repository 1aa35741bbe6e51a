"""Isolation trees on arrays: growing one from a small sample, and scoring points with a forest.

Runs inside Spark tasks, so nothing here touches Spark.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa

# Trees of a forest and points a tree is grown from.
TREES = 100
SUBSAMPLE = 256
NODE_ARRAYS = ("feature", "cut", "left", "right", "path")
# Path lengths are whole numbers of this part; random streams step by the golden ratio.
PATH_UNIT = 1 << 32
GOLDEN = 0x9E3779B97F4A7C15
# Points that walk all trees together.
POINTS_PER_WALK = 1024


def average_path(size: float) -> float:
    """Mean path length of an unsuccessful search among ``size`` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (math.log(size - 1.0) + np.euler_gamma) - 2.0 * (size - 1.0) / size


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def node_draws(seed: int, tree: int, nodes: int) -> np.ndarray:
    """Two draws in [0, 1) for each node below ``nodes``, of the feature and of the cut.

    They depend on the series, the tree and the node alone, so that any engine can repeat them.
    """
    counter = np.arange(2 * nodes, dtype=np.uint64) + np.uint64(tree << 20)
    bits = mixed(np.uint64(seed) + counter * np.uint64(GOLDEN))
    return ((bits >> np.uint64(11)) * 2.0**-53).reshape(-1, 2)


def leaf_path(depth: int, size: int) -> int:
    """Path length of a leaf in whole parts of ``PATH_UNIT``, so that sums do not depend on order."""
    return round((depth + average_path(size)) * PATH_UNIT)


def build_tree(points: np.ndarray, seed: int, tree: int, depth_limit: int) -> dict[str, np.ndarray]:
    """One isolation tree as parallel node arrays; leaves have feature -1 and a path length.

    Draws belong to a node's place: the root is 1 and the children of i are 2i and 2i + 1.
    """
    draws = node_draws(seed, tree, 1 << (depth_limit + 1)).tolist()
    single = points.shape[1] == 1
    ordered = np.sort(points[:, 0]).tolist() if single else []
    feature: list[int] = []
    cuts: list[float] = []
    left: list[int] = []
    right: list[int] = []
    path: list[int] = []

    def choose(members: np.ndarray, draw: float) -> tuple[int, float, float] | None:
        low, high = members.min(axis=0), members.max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(varying) == 0:
            return None
        chosen = int(varying[int(draw * len(varying))])
        return chosen, float(low[chosen]), float(high[chosen])

    def add(members: np.ndarray | None, start: int, stop: int, depth: int, place: int) -> int:
        # One feature: members are ordered[start:stop]. More: members holds the points.
        node, size = len(feature), stop - start
        feature.append(-1)
        cuts.append(0.0)
        left.append(-1)
        right.append(-1)
        path.append(leaf_path(depth, size))
        if depth >= depth_limit or size <= 1:
            return node
        if single:
            picked = (0, ordered[start], ordered[stop - 1])
            if picked[1] == picked[2]:
                return node
        else:
            picked = choose(members, draws[place][0])
            if picked is None:
                return node
        chosen, low, high = picked
        cut = low + draws[place][1] * (high - low)
        if cut >= high:
            cut = low
        feature[node], cuts[node] = chosen, cut
        below, above = 2 * place, 2 * place + 1
        if single:
            middle = bisect.bisect_right(ordered, cut, start, stop)
            left[node] = add(None, start, middle, depth + 1, below)
            right[node] = add(None, middle, stop, depth + 1, above)
        else:
            goes_left = members[:, chosen] <= cut
            low_side, high_side = members[goes_left], members[~goes_left]
            left[node] = add(low_side, 0, len(low_side), depth + 1, below)
            right[node] = add(high_side, 0, len(high_side), depth + 1, above)
        return node

    add(None if single else points, 0, len(points), 0, 1)
    return {
        "feature": np.array(feature, dtype=np.int32),
        "cut": np.array(cuts),
        "left": np.array(left, dtype=np.int32),
        "right": np.array(right, dtype=np.int32),
        "path": np.array(path, dtype=np.int64),
    }


def tree_draws(drawn: np.ndarray, tree: int) -> np.ndarray:
    """Uniform 64-bit draws of rows for one tree, from the rows' hashes."""
    return mixed(drawn.view(np.uint64) + np.uint64((tree + 1) * GOLDEN % (1 << 64)))


def may_be_drawn(drawn: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of series of ``n`` fit rows that some tree can draw: a superset of all subsamples.

    A tree takes the ``SUBSAMPLE`` smallest draws of all fit rows. Twice that many rows are expected
    below the limit, so that fewer than ``SUBSAMPLE`` fall below it in one of 10**20 trees.
    """
    limit = np.minimum(2.0 * SUBSAMPLE / np.maximum(n, 1), 1.0) * 2.0**64
    wanted = np.zeros(len(drawn), dtype=bool)
    for tree in range(TREES):
        wanted |= tree_draws(drawn, tree) < limit
    return wanted


def grow_forest(
    points: np.ndarray, drawn: np.ndarray, n: int, name: str
) -> list[dict[str, np.ndarray]]:
    """The trees of one series, each from its own subsample, drawn from all fit rows.

    ``points`` and their hashes ``drawn`` may come in any order; ``n`` is the length of the fit
    window. The same rows and name always grow the same forest, and rows that no tree can draw may
    be left out.
    """
    order = np.lexsort((*points.T, drawn))
    points, drawn = points[order], drawn[order]
    seed = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")
    size = min(SUBSAMPLE, n, len(points))
    limit = math.ceil(math.log2(max(size, 2)))
    trees = []
    for tree in range(TREES):
        draws = tree_draws(drawn, tree)
        taken = np.argpartition(draws, size - 1)[:size] if size else np.zeros(0, dtype=np.int64)
        trees.append(build_tree(points[taken], seed, tree, limit))
    return trees


def grow_from_table(
    table: pa.Table, keys: Sequence[str], features: Sequence[str], seed: int
) -> list[dict[str, np.ndarray]]:
    """``grow_forest`` for rows of one series with its keys, features, ``drawn`` and ``n``."""
    points = np.column_stack([table[f].to_numpy().astype(np.float64) for f in features])
    name = json.dumps([seed, *[str(table[k][0].as_py()) for k in keys]])
    return grow_forest(points, table["drawn"].to_numpy(), table["n"][0].as_py(), name)


class Forest:
    """The forest of one series, ready to score arrays of points."""

    def __init__(self, trees: Sequence[Mapping[str, np.ndarray]], n: int) -> None:
        lengths = np.array([len(tree["feature"]) for tree in trees])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])

        def flat(name: str) -> np.ndarray:
            return np.concatenate([tree[name] for tree in trees])

        # All trees in one set of arrays: children point into it, leaves point to themselves.
        shift = np.repeat(starts, lengths)
        here = np.arange(len(shift))
        feature = flat("feature")
        self.roots = starts
        self.leaf = feature < 0
        self.feature = np.maximum(feature, 0)
        self.cut = flat("cut")
        self.left = np.where(self.leaf, here, flat("left") + shift)
        self.right = np.where(self.leaf, here, flat("right") + shift)
        self.path = flat("path")
        self.scale = len(trees) * (average_path(min(SUBSAMPLE, n)) or 1.0) * PATH_UNIT
        self.step: tuple[np.ndarray, np.ndarray] | None = None
        if feature.max(initial=-1) <= 0:
            self.step = self._step_function(np.repeat(np.arange(len(trees)), lengths))

    @classmethod
    def from_table(cls, rows: pa.Table) -> Forest:
        """From one row of node arrays per tree."""
        rows = rows.sort_by("tree").combine_chunks()
        trees = [
            {name: rows[name][i].values.to_numpy() for name in NODE_ARRAYS}
            for i in range(rows.num_rows)
        ]
        return cls(trees, rows["n"][0].as_py())

    def _walk(self, node: np.ndarray, value_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Path length reached from each start node; ``value_of(nodes)`` gives the tested values."""
        while not self.leaf[node].all():
            node = np.where(value_of(node) <= self.cut[node], self.left[node], self.right[node])
        return self.path[node]

    def _step_function(self, tree_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With one feature the total path length is a step function of the value."""
        inner = np.flatnonzero(~self.leaf)
        inner = inner[np.lexsort((self.cut[inner], tree_of[inner]))]
        cuts, trees = self.cut[inner], tree_of[inner]
        below = self._walk(self.roots[trees], lambda node: cuts)
        last = self._walk(self.roots.copy(), lambda node: np.full(len(node), np.inf))
        # Path just above a cut: that of the next cut in the same tree, or of the tree's last leaf.
        above = np.append(below[1:], 0)
        ends = np.append(trees[1:] != trees[:-1], True) if len(trees) else np.zeros(0, dtype=bool)
        above[: len(trees)][ends] = last[trees[ends]]
        first = np.ones(len(trees), dtype=bool)
        first[1:] = trees[1:] != trees[:-1]
        start = last.copy()
        start[trees[first]] = below[first]
        order = np.argsort(cuts, kind="stable")
        jumps = (above[: len(trees)] - below)[order]
        return cuts[order], start.sum() + np.concatenate([[0], np.cumsum(jumps)])

    def sample_scores(self, points: np.ndarray) -> np.ndarray:
        if self.step is not None:
            cuts, totals = self.step
            total = totals[np.searchsorted(cuts, points[:, 0], side="left")]
        else:
            # All trees at once, for as many points as keep the arrays in the processor's cache.
            total = np.empty(len(points), dtype=np.int64)
            for start in range(0, len(points), POINTS_PER_WALK):
                some = points[start : start + POINTS_PER_WALK]
                nodes = np.repeat(self.roots[:, None], len(some), axis=1)
                columns = np.arange(len(some))[None, :]
                paths = self._walk(nodes, lambda node: some[columns, self.feature[node]])
                total[start : start + len(some)] = paths.sum(axis=0)
        return -np.exp2(-total / self.scale)
