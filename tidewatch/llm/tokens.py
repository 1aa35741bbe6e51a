"""Words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewatch.llm.common import travels_with_tasks

travels_with_tasks(__name__)

# Texts of about so many bytes are looked at together.
TOGETHER = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row borders of runs of rows; null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    borders = np.frombuffer(column.buffers()[1], dtype=np.int64)
    borders = borders[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(borders, borders[first] + TOGETHER, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, whole[borders[first] : borders[last]], borders[first : last + 1] - borders[first]
        first = last


def white_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[9, 10, 11, 12, 13, 32]] = True
    return table


def find_words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses a border."""
    inside = ~white_space()[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(np.diff(borders) > 0)
    at = borders[full]
    starts[at] = inside[at]
    at = borders[full + 1] - 1
    ends[at] = inside[at]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


class WordHasher:
    """64-bit hashes of byte ranges, A-Z like a-z, from one running sum over the bytes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        lower = np.arange(256)
        lower[65:91] += 32
        self.lower = lower.astype(np.uint8)
        self._values = mix64(lower.astype(np.uint64) + np.uint64(1))
        self._grow(TOGETHER)

    def _grow(self, n: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        for name, base in (("_powers", self.BASE), ("_inverse", inverse)):
            powers = np.full(n + 1, base, dtype=np.uint64)
            powers[0] = 1
            setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self._powers):
            self._grow(2 * len(data))
        running = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self._values[data] * self._powers[: len(data)], out=running[1:])
        hashed = (running[ends] - running[starts]) * self._inverse[starts]
        return mix64(hashed + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
