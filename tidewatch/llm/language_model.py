"""A word n-gram language model with deleted interpolation.

Jelinek and Mercer (1980): maximum-likelihood estimates of orders 2, 1 and 0 are mixed; the weights
depend on how often the context was seen, and expectation-maximisation learns them on counts of texts
that were held out of the estimates. The symbols are the most frequent words, one symbol for all
rarer words, and the end of a text. Which of the rarer words it is has a mixture of its own, of
order 1 and of equal shares for all of them and one that was never seen.

What travels: word counts per task; then counts of symbol pairs per task, as sorted ids in blobs of
one of many buckets; then, for scoring, ids and row numbers in the same buckets, where they meet the
counts. Pairs frequent enough to crowd a bucket are few by definition and are looked up in the task
that reads the text. A bucket answers with sums per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import in_fold, table, travels_with_tasks
from tidewatch.llm.tokens import WordHasher, find_words, text_slices
from tidewatch.session import configure, settle

travels_with_tasks(__name__)

# Size of the symbol table, so that two symbols fit 32 bits; the other words share a symbol.
SYMBOLS = 65_000
# A pair with at least this share of all pairs is looked up where it is read: at most 2**14 are.
FREQUENT = 2.0**-14
# Tokens of the texts a task looks at together, and pairs of a bucket, on average.
TOGETHER = 1_000_000
PER_BUCKET = 16_000_000
LEAST_BUCKETS = 64
# Every tenth training text is held out of the estimates when the weights are learned.
HELD_OUT = 10
ROUNDS = 60


@dataclass
class Texts:
    """Tokens of some rows in text order; the last token of each row is its end."""

    rows: int
    of: np.ndarray
    hashes: np.ndarray
    is_end: np.ndarray


def read_texts(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, Texts]]:
    """First row and tokens of runs of rows with about ``TOGETHER`` tokens."""
    kept: list = []
    first, words = 0, 0

    def joined() -> Texts:
        base = np.cumsum([0, *(k[2] for k in kept[:-1])])
        of_word = np.concatenate([k[0] + b for k, b in zip(kept, base, strict=True)])
        rows = sum(k[2] for k in kept)
        total = len(of_word) + rows
        place = np.arange(len(of_word)) + of_word
        is_end = np.ones(total, dtype=bool)
        is_end[place] = False
        of = np.empty(total, dtype=np.int64)
        of[place], of[is_end] = of_word, np.arange(rows)
        hashes = np.zeros(total, dtype=np.uint64)
        hashes[place] = np.concatenate([k[1] for k in kept])
        return Texts(rows, of, hashes, is_end)

    for at, data, borders in text_slices(column):
        starts, ends, of = find_words(data, borders)
        kept.append((of, hasher(data, starts, ends), len(borders) - 1))
        words += len(starts) + len(borders) - 1
        if words >= TOGETHER:
            yield first, joined()
            kept, words, first = [], 0, at + len(borders) - 1
    if kept:
        yield first, joined()


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return (keys, *(c[:0].astype(np.int64) for c in counts))
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[heads], *(np.add.reduceat(c[order].astype(np.int64), heads) for c in counts))


class Gathered:
    """Counts of keys in kept and held-out texts, summed up within a task."""

    def __init__(self, dtype: type, most: int = 3_000_000) -> None:
        self.dtype, self.most = dtype, most
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, held: np.ndarray) -> bool:
        """Whether there are now so many that they should be taken."""
        part = summed(keys, ~held, held)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.most:
            self._merge()
        return self.size > self.most // 2 and len(self.parts) == 1

    def _merge(self) -> None:
        merged = summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.parts, self.size = [merged], len(merged[0])

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(self.dtype), none, none
        self._merge()
        (out,) = self.parts
        self.parts, self.size = [], 0
        return out


def pack_ids(ids: np.ndarray) -> bytes:
    """Sorted unsigned 32-bit numbers as their differences, two bytes each where that suffices."""
    steps = np.diff(ids, prepend=ids[:1])
    first = np.array([ids[0]] if len(ids) else [], dtype="<u4").tobytes()
    small = not len(steps) or steps.max() < 65536
    return first + steps.astype("<u2" if small else "<u4").tobytes()


def unpack_ids(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.uint32)
    steps = np.frombuffer(packed, dtype="<u2" if len(packed) == 4 + 2 * n else "<u4", offset=4)
    first = np.frombuffer(packed, dtype="<u4", count=1)[0]
    return (np.cumsum(steps, dtype=np.uint64) + np.uint64(first)).astype(np.uint32)


def pack_numbers(values: np.ndarray) -> bytes:
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u8").tobytes()


def unpack_numbers(packed: bytes, n: int) -> np.ndarray:
    kinds = {1: "<u1", 2: "<u2", 8: "<u8"}
    return np.frombuffer(packed, dtype=kinds[len(packed) // n] if n else "<u1").astype(np.int64)


def scrambled(pairs: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, so that equal ranges hold equally many pairs."""
    x = pairs.astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def unscrambled(x: np.ndarray) -> np.ndarray:
    back = [pow(k, -1, 1 << 32) for k in (0x846CA68B, 0x7FEB352D)]
    x = (x ^ (x >> np.uint32(16))) * np.uint32(back[0])
    x = (x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))) * np.uint32(back[1])
    return x ^ (x >> np.uint32(16))


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket per power of two."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)


def learn_weights(buckets: np.ndarray, estimates: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mixture weights per bucket by expectation-maximisation; columns are orders, lowest first.

    ``estimates`` may share any factor within a row. One pseudo-count per order keeps every weight
    above zero.
    """
    orders = estimates.shape[1]
    weights = np.full((64, orders), 1.0 / orders)
    for _ in range(ROUNDS if len(counts) else 0):
        joint = weights[buckets] * estimates
        share = joint / joint.sum(axis=1, keepdims=True) * counts[:, None]
        total = np.ones((64, orders))
        np.add.at(total, buckets, share)
        weights = total / total.sum(axis=1, keepdims=True)
    # In a context never seen, the highest order knows nothing.
    weights[0, -1] = 0.0
    weights[0] /= weights[0].sum()
    return weights


@dataclass
class Vocabulary:
    """The symbols: frequent words by sorted hash, then all rarer words, then the end of a text."""

    hashes: np.ndarray
    kept: np.ndarray
    held: np.ndarray
    distinct: int
    rare_weights: np.ndarray

    @property
    def rare(self) -> int:
        return len(self.hashes)

    @property
    def end(self) -> int:
        return len(self.hashes) + 1

    @property
    def total(self) -> np.ndarray:
        return self.kept + self.held

    def symbols(self, texts: Texts) -> np.ndarray:
        out = np.full(len(texts.hashes), self.rare, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, texts.hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == texts.hashes, at, out)
        out[texts.is_end] = self.end
        return out

    def pairs(self, symbols: np.ndarray) -> np.ndarray:
        """Scrambled id of each token after the one before it; a text starts after an end."""
        before = np.concatenate([[self.end], symbols[:-1]])
        return scrambled(before << 16 | symbols)

    def rare_log10(self, counts: np.ndarray) -> np.ndarray:
        """Of rarer words, given that it is one, by how often they were seen in training."""
        equal = 1 / (self.distinct - len(self.hashes) + 1)
        one = counts / max(self.total[self.rare], 1)
        return np.log10(self.rare_weights[0] * equal + self.rare_weights[1] * one)

    def lower_estimates(self, pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Count of the context, and estimates of orders 0 and 1, of scrambled pairs."""
        plain = unscrambled(pairs).astype(np.int64)
        word = counts[plain & 65535] / max(counts.sum(), 1)
        return counts[plain >> 16], np.full(len(plain), 1 / len(counts)), word


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray

    def log10(self, pairs: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Of scrambled pairs that were seen so often in training."""
        context, zero, one = self.vocabulary.lower_estimates(pairs, self.vocabulary.total)
        weights = self.weights[frequency_bucket(context)]
        two = seen / np.maximum(context, 1)
        return np.log10(weights[:, 0] * zero + weights[:, 1] * one + weights[:, 2] * two)


def _look_up(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _training(batch: pa.RecordBatch, first: int, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token's text is held out, for training texts only, and which tokens these are."""
    part = slice(first, first + texts.rows)
    held = batch.column(2).to_numpy(zero_copy_only=False)[part]
    learned = batch.column(1).to_numpy(zero_copy_only=False)[part]
    use = learned[texts.of]
    return held[texts.of][use], use


def _as_signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def count_words(rows: DataFrame) -> DataFrame:
    """``hash, kept, held`` of the words of training texts; the ends of texts have hash 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = WordHasher(), Gathered(np.uint64)

        def taken() -> pa.RecordBatch:
            hashes, kept, held = found.take()
            arrays = [pa.array(_as_signed(hashes)), pa.array(kept), pa.array(held)]
            return pa.RecordBatch.from_arrays(arrays, names=["hash", "kept", "held"])

        for batch in batches:
            for first, texts in read_texts(batch.column(0), hasher):
                held, use = _training(batch, first, texts)
                if found.add(texts.hashes[use], held):
                    yield taken()
        yield taken()

    counted = rows.select("text", "learned", "held").mapInArrow(run, "hash long, kept long, held long")
    return counted.groupBy("hash").agg(F.sum("kept").alias("kept"), F.sum("held").alias("held"))


def choose_vocabulary(words: DataFrame, most: int = SYMBOLS) -> Vocabulary:
    """The most frequent words, at most ``most``: all above a frequency that leaves no more."""
    real = words.where("hash != 0")
    level = F.floor(F.log2(F.col("kept") + F.col("held")) * 32).cast("int")
    levels = real.groupBy(level.alias("level")).agg(F.count("*").alias("n"))
    room, least = most, 1 << 20
    for row in sorted(levels.collect(), reverse=True):
        room -= row["n"]
        if room < 0:
            break
        least = row["level"]
    chosen = real.where(level >= least).toPandas()
    hashes = chosen["hash"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    sums = words.groupBy((F.col("hash") == 0).alias("end")).agg(
        F.sum("kept"), F.sum("held"), F.count("*")
    )
    by_end = {row["end"]: row for row in sums.collect()}
    end, rest = by_end.get(True, (True, 0, 0, 0)), by_end.get(False, (False, 0, 0, 0))
    counts = []
    for i, name in ((1, "kept"), (2, "held")):
        own = chosen[name].to_numpy(dtype=np.int64)[order]
        counts.append(np.concatenate([own, [rest[i] - own.sum(), end[i]]]))

    # Held-out rarer words by how often the other texts have them, in the same fine levels.
    seen = F.when(F.col("kept") > 0, F.floor(F.log2("kept") * 32)).otherwise(-1)
    rarer = real.where(level < least).groupBy(seen.alias("level"))
    rows = rarer.agg(F.avg("kept"), F.sum("held"), F.count("*")).collect()
    mean, held, n = (np.array([row[i] for row in rows], dtype=np.float64) for i in (1, 2, 3))
    equal = np.full(len(rows), 1 / (n[mean > 0].sum() + 1))
    estimates = np.stack([equal, mean / max(counts[0][-2], 1)], axis=1)
    weights = learn_weights(np.ones(len(rows), dtype=np.int64), estimates, held)[1]
    return Vocabulary(hashes[order], *counts, rest[3], weights)


PAIRS = "bucket long, n long, ids binary, kept binary, held binary"
COUNTED = (
    "bucket long, n long, ids binary, counts binary, frequent array<long>, frequent_counts array<long>, "
    "cells array<long>, cell_counts array<long>"
)


def _cell(bucket: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Bucket and quarter-octaves of the ratios of estimates, as one number; 0 for a ratio of 0."""

    def octave(ratio: np.ndarray) -> np.ndarray:
        return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-30)) * 4) + 1000, 0).astype(np.int64)

    return bucket << 40 | octave(one) << 20 | octave(two)


def count_pairs(rows: DataFrame, vocabulary: Vocabulary, bits: int) -> DataFrame:
    """Counts of symbol pairs of training texts, in ``2**bits`` buckets."""
    shift = np.uint32(32 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = WordHasher(), Gathered(np.uint32)

        def taken() -> pa.RecordBatch:
            ids, kept, held = found.take()
            out = [
                (bucket, b - a, pack_ids(ids[a:b]), pack_numbers(kept[a:b]), pack_numbers(held[a:b]))
                for bucket, a, b in _runs(ids, shift)
            ]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, PAIR_SCHEMA.types, strict=True)],
                schema=PAIR_SCHEMA,
            )

        for batch in batches:
            for first, texts in read_texts(batch.column(0), hasher):
                held, use = _training(batch, first, texts)
                if found.add(vocabulary.pairs(vocabulary.symbols(texts))[use], held):
                    yield taken()
        yield taken()

    parts = rows.select("text", "learned", "held").mapInArrow(run, PAIRS)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids, kept, held = summed(
            np.concatenate([unpack_ids(r["ids"], r["n"]) for r in rows]),
            *(np.concatenate([unpack_numbers(r[k], r["n"]) for r in rows]) for k in ("kept", "held")),
        )
        counts = kept + held
        often = counts >= max(2, FREQUENT * vocabulary.total.sum())
        some = held > 0
        context, zero, one = vocabulary.lower_estimates(ids[some], vocabulary.kept)
        two = kept[some] / np.maximum(context, 1)
        cells = _cell(frequency_bucket(context), one / zero, two / zero)
        cells, cell_counts = summed(cells, held[some])
        return pa.Table.from_pylist([{
            "bucket": rows[0]["bucket"], "n": len(ids), "ids": pack_ids(ids),
            "counts": pack_numbers(counts),
            "frequent": ids[often].astype(np.int64), "frequent_counts": counts[often],
            "cells": cells, "cell_counts": cell_counts,
        }], schema=COUNTED_SCHEMA)

    return settle(parts.groupBy("bucket").applyInArrow(merge, COUNTED))


PAIR_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("n", pa.int64()), *((k, pa.binary()) for k in ("ids", "kept", "held"))]
)
COUNTED_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()),
     *((k, pa.list_(pa.int64())) for k in ("frequent", "frequent_counts", "cells", "cell_counts"))]
)


def _runs(ids: np.ndarray, shift: np.uint32 | np.uint64) -> Iterator[tuple[int, int, int]]:
    """Bucket and range of each run of sorted ids with equal top bits."""
    if len(ids):
        top = (ids >> shift).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], strict=True):
            yield int(top[a]), a, b


def fit(rows: DataFrame, words: DataFrame, bits: int) -> tuple[Model, DataFrame]:
    """The model, and the table of pair counts by bucket that goes with it."""
    vocabulary = choose_vocabulary(words)
    counted = count_pairs(rows, vocabulary, bits)

    def exploded(key: str, value: str) -> DataFrame:
        return counted.select(F.explode(F.arrays_zip(key, value)).alias("x")).select(
            F.col(f"x.{key}").alias("k"), F.col(f"x.{value}").alias("n")
        )

    cells = exploded("cells", "cell_counts").groupBy("k").agg(F.sum("n").alias("n")).toPandas().sort_values("k")
    code = cells["k"].to_numpy(dtype=np.int64)

    def ratio(part: np.ndarray) -> np.ndarray:
        return np.where(part > 0, 2.0 ** ((part - 1000) / 4), 0.0)

    estimates = np.stack([np.ones(len(code)), ratio(code >> 20 & 0xFFFFF), ratio(code & 0xFFFFF)], axis=1)
    weights = learn_weights(code >> 40, estimates, cells["n"].to_numpy(dtype=np.float64))
    often = exploded("frequent", "frequent_counts").toPandas().sort_values("k")
    frequent = often["k"].to_numpy(dtype=np.int64).astype(np.uint32)
    model = Model(vocabulary, weights, frequent, often["n"].to_numpy(dtype=np.int64))
    return model, counted


ENTRIES = (
    "chunk long, bucket long, doc_ids array<long>, n_tokens array<long>, n_known array<long>, "
    "base array<double>, score array<double>, n long, ids binary, of binary, words binary, word_of binary"
)
SUMS = (
    "chunk long, doc_ids array<long>, n_tokens array<long>, n_known array<long>, base array<double>, "
    "score array<double>, of binary, sums binary, word_of binary, word_base binary, word_score binary, word_known binary"
)
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _schema(names: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(names.items()))


_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
_OWN = {"doc_ids": _LONGS, "n_tokens": _LONGS, "n_known": _LONGS, "base": _DOUBLES, "score": _DOUBLES}
ENTRY_SCHEMA = _schema(
    {"chunk": pa.int64(), "bucket": pa.int64(), **_OWN, "n": pa.int64(),
     **{k: pa.binary() for k in ("ids", "of", "words", "word_of")}}
)
SUM_SCHEMA = _schema(
    {"chunk": pa.int64(), **_OWN,
     **{k: pa.binary() for k in ("of", "sums", "word_of", "word_base", "word_score", "word_known")}}
)


def _by_row(of: np.ndarray, rows: int, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows that occur, and the sums of values over each."""
    present = np.flatnonzero(np.bincount(of, minlength=rows))
    return (present, *(np.bincount(of, weights=v, minlength=rows)[present] for v in values))


def score_texts(rows: DataFrame, words: DataFrame, model: Model, counted: DataFrame, bits: int) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row."""
    vocabulary = model.vocabulary
    total = float(vocabulary.total.sum())
    distinct = vocabulary.distinct + int(vocabulary.total[vocabulary.end] > 0)
    floor = total + 0.5 * (distinct + 1)
    shift, word_shift = np.uint32(32 - bits), np.uint64(64 - bits)

    def base(counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / floor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        hasher, chunk = WordHasher(), (context.partitionId() if context else 0) << 32
        for batch in batches:
            for first, texts in read_texts(batch.column(0), hasher):
                out: list[dict] = []
                symbols, n = vocabulary.symbols(texts), texts.rows
                listed = symbols != vocabulary.rare
                counts = vocabulary.total[symbols]
                known = np.bincount(texts.of[listed & (counts > 0)], minlength=n)
                own_base = np.bincount(texts.of[listed], weights=base(counts[listed]), minlength=n)

                pairs = vocabulary.pairs(symbols)
                seen = _look_up(model.frequent, model.frequent_counts, pairs)
                here = seen > 0
                score = np.bincount(texts.of[here], weights=model.log10(pairs[here], seen[here]), minlength=n)
                out.append({
                    "chunk": chunk, "bucket": chunk % (1 << bits),
                    "doc_ids": batch.column(1)[first : first + n].to_pylist(),
                    "n_tokens": np.bincount(texts.of, minlength=n), "n_known": known,
                    "base": own_base, "score": score,
                })
                pairs, of = pairs[~here], texts.of[~here]
                order = np.argsort(pairs, kind="stable")
                pairs, of = pairs[order], of[order]
                hashes, rare_of = texts.hashes[~listed], texts.of[~listed]
                order = np.argsort(hashes, kind="stable")
                hashes, rare_of = hashes[order], rare_of[order]
                rare_runs = {bucket: (a, b) for bucket, a, b in _runs(hashes, word_shift)}
                pair_runs = {bucket: (a, b) for bucket, a, b in _runs(pairs, shift)}
                for bucket in sorted(rare_runs.keys() | pair_runs.keys()):
                    (a, b), (c, d) = pair_runs.get(bucket, (0, 0)), rare_runs.get(bucket, (0, 0))
                    out.append({
                        "chunk": chunk, "bucket": bucket, "n": b - a,
                        "ids": pack_ids(pairs[a:b]), "of": of[a:b].astype("<u4" if n > 65536 else "<u2").tobytes(),
                        "words": hashes[c:d].tobytes(), "word_of": rare_of[c:d].astype("<u4").tobytes(),
                    })
                chunk += 1
                yield pa.RecordBatch.from_pylist(out, schema=ENTRY_SCHEMA)

    entries = rows.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, ENTRIES)
    bucket = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")
    none = F.lit(None).cast("binary")
    rare = words.where("hash != 0").select(
        bucket.alias("bucket"), "hash", (F.col("kept") + F.col("held")).alias("count"),
        F.lit(0).cast("long").alias("n"), none.alias("ids"), none.alias("counts"),
    )
    nothing = F.lit(0).cast("long")
    tables = rare.union(counted.select("bucket", nothing, nothing, "n", "ids", "counts"))

    def meet(texts: pa.Table, known: pa.Table) -> pa.Table:
        out: list[dict] = []
        ids, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        is_table = np.array(known["ids"].is_valid()) if known.num_rows else np.zeros(0, dtype=bool)
        for row in known.filter(pa.array(is_table)).to_pylist() if is_table.any() else ():
            ids, counts = unpack_ids(row["ids"], row["n"]), unpack_numbers(row["counts"], row["n"])
        hashes = known["hash"].to_numpy().view(np.uint64)[~is_table] if known.num_rows else np.zeros(0, np.uint64)
        word_counts = known["count"].to_numpy()[~is_table] if known.num_rows else np.zeros(0, np.int64)
        order = np.argsort(hashes)
        hashes, word_counts = hashes[order], word_counts[order]
        for batch in texts.to_batches():
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["doc_ids"] is not None:
                    out.append({name: row[name] for name in ("chunk", *_OWN)})
                    continue
                n = row["n"]
                pairs = unpack_ids(row["ids"], n)
                of = np.frombuffer(row["of"], dtype="<u2" if len(row["of"]) == 2 * n else "<u4").astype(np.int64)
                word_of = np.frombuffer(row["word_of"], dtype="<u4").astype(np.int64)
                found = _look_up(hashes, word_counts, np.frombuffer(row["words"], dtype=np.uint64))
                rows_in = int(max(of.max(initial=-1), word_of.max(initial=-1))) + 1
                at, sums = _by_row(of, rows_in, model.log10(pairs, _look_up(ids, counts, pairs)))
                word_at, bases, knowns, scores = _by_row(
                    word_of, rows_in, base(found), found > 0, vocabulary.rare_log10(found)
                )
                kind = "<u2" if rows_in <= 65536 else "<u4"
                out.append({
                    "chunk": row["chunk"], "of": at.astype(kind).tobytes(), "sums": sums.astype("<f4").tobytes(),
                    "word_of": word_at.astype(kind).tobytes(), "word_base": bases.astype("<f8").tobytes(),
                    "word_score": scores.astype("<f4").tobytes(), "word_known": knowns.astype("<u4").tobytes(),
                })
        return pa.Table.from_pylist(out, schema=SUM_SCHEMA)

    sums = entries.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(meet, SUMS)

    def finish(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(row for row in rows if row["doc_ids"] is not None)
        known, bases, score = (np.array(own[k], dtype=np.float64) for k in ("n_known", "base", "score"))
        for row in rows:
            if row["doc_ids"] is None:
                values = np.frombuffer(row["sums"], dtype="<f4")
                kind = "<u2" if len(row["of"]) == 2 * len(values) else "<u4"
                score[np.frombuffer(row["of"], dtype=kind)] += values
                values = np.frombuffer(row["word_base"], dtype="<f8")
                kind = "<u2" if len(row["word_of"]) == 2 * len(values) else "<u4"
                at = np.frombuffer(row["word_of"], dtype=kind)
                bases[at] += values
                score[at] += np.frombuffer(row["word_score"], dtype="<f4")
                known[at] += np.frombuffer(row["word_known"], dtype="<u4")
        return pa.table({
            "doc_id": pa.array(own["doc_ids"], type=pa.int64()),
            "n_tokens": pa.array(own["n_tokens"], type=pa.int64()),
            "n_known": known.astype(np.int64), "base_score": bases, "score": score,
        })

    return sums.groupBy("chunk").applyInArrow(finish, SCORES)


def score_documents(docs: DataFrame, learned: Column) -> DataFrame:
    """Score every text of ``docs`` by a model of those that ``learned`` marks.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored except in ``learned``. Tokens are
    words, A-Z as a-z, and one end per text. Returns ``doc_id``; ``n_tokens``; ``n_known``, tokens
    that the training texts have; ``train_tokens``; ``base_score``, the sum of
    ``log10((c + 0.5) / (N + 0.5 (V + 1)))``; and ``score``, the model's log10 probability of the text.
    Null texts are empty and have one token. Null ids are scored and, like any other, learned from if
    so marked. Repeated rows count and score like others. Without training texts, all estimates fall
    back to equal shares. A few scores are added in single precision, to about 1e-4.
    """
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    held = F.floor(number / 5) % HELD_OUT == 0
    rows = docs.select("doc_id", "text", learned.alias("learned"), held.alias("held"))
    words = settle(count_words(rows))
    tokens = words.agg(F.sum(F.col("kept") + F.col("held"))).first()[0] or 0
    bits = max(LEAST_BUCKETS, math.ceil(tokens / PER_BUCKET)).bit_length() - 1
    model, counted = fit(rows, words, bits)
    scored = score_texts(rows, words, model, counted, bits)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    held_out = in_fold(F.col("doc_id"), 5, 1)
    scored = score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)
