"""Ranked lexical search: hybrid of term-at-a-time and document-at-a-time evaluation.

Every task turns the documents it reads into segments of an inverted index; nothing is shuffled for
it. A query's short lists in a segment are summed term at a time into accumulators, which from then on
are one more bounded list. It and the long lists are walked document at a time, in windows: a window
whose bounds cannot reach the lowest of the best scores so far is skipped whole, and in any other the
long lists are added in order of their bounds until what remains cannot matter. Skipping needs a bound
strictly below that score, so ties are never lost.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, table, travels_with_tasks
from tidewatch.session import configure, settle

travels_with_tasks(__name__)

BEST = 50
# A segment closes at so many bytes of text or documents: what a task holds at a time.
SEGMENT_BYTES = 8 << 20
SEGMENT_DOCS = 1 << 14
SLICE_BYTES = 1 << 20
# A task writes out the segments it has made at so many bytes, whatever it reads.
GROUP_BYTES = 16 << 20
# Lists in at least this share of a segment's documents are long.
LONG_SHARE = 1 / 8
WINDOW = 512
# Query terms sent to the tasks at a time; more are answered block by block.
TERMS_TOGETHER = 200_000
FANS = 256

# Terms are runs of ASCII letters, digits and all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEPT = set((string.digits + string.ascii_letters).encode())
LETTERS = bytes(i if i in _KEPT or i > 127 else 32 for i in range(256)).lower()

SEGMENT = (
    "terms array<binary>, counts array<int>, docs array<int>, tfs array<int>, ids array<long>, "
    "sizes array<long>, n_docs long, n_terms long"
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order; only A-Z are lower-cased."""
    return (text or "").encode().translate(LETTERS).split()


class SegmentBuilder:
    """Documents of one segment, as dictionary codes of their terms."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0
        self._tokens: list[bytes] = []
        self._owners: list[tuple[int, int]] = []
        self._parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        kept = (text or "").encode().translate(LETTERS)
        self.ids.append(doc_id)
        self.bytes += len(kept)
        size = start = 0
        while start < len(kept):
            end = kept.find(b" ", start + SLICE_BYTES)
            end = len(kept) if end < 0 else end
            tokens = kept[start:end].split()
            size += len(tokens)
            self._tokens += tokens
            self._owners.append((len(self.ids) - 1, len(tokens)))
            if len(self._tokens) >= 200_000:
                self._encode()
            start = end
        self.sizes.append(size)

    def _encode(self) -> None:
        coded = pa.array(self._tokens, type=pa.binary()).dictionary_encode()
        owners, lengths = zip(*self._owners, strict=True)
        docs = np.repeat(np.array(owners, dtype=np.int64), lengths)
        self._parts.append((coded.dictionary, coded.indices.to_numpy(), docs))
        self._tokens, self._owners = [], []

    def full(self) -> bool:
        return self.bytes >= SEGMENT_BYTES or len(self.ids) >= SEGMENT_DOCS

    def build(self) -> pa.RecordBatch:
        if self._tokens:
            self._encode()
        n, keys, terms = len(self.ids), np.zeros(0, dtype=np.int64), pa.array([], type=pa.binary())
        if self._parts:
            merged = pa.chunked_array([part[0] for part in self._parts]).combine_chunks()
            merged = merged.dictionary_encode()
            terms, codes, at, found = merged.dictionary, merged.indices.to_numpy(), 0, []
            for dictionary, indices, docs in self._parts:
                own = codes[at : at + len(dictionary)].astype(np.int64)
                found.append(own[indices] * n + docs)
                at += len(dictionary)
            keys = np.concatenate(found)
        postings, tfs = np.unique(keys, return_counts=True)
        counts = np.bincount(postings // n, minlength=len(terms)) if n else np.zeros(0)
        sizes = np.array(self.sizes, dtype=np.int64)
        columns = [
            _one_list(terms, pa.binary()),
            _one_list(counts.astype(np.int32), pa.int32()),
            _one_list((postings % max(n, 1)).astype(np.int32), pa.int32()),
            _one_list(tfs.astype(np.int32), pa.int32()),
            _one_list(self.ids, pa.int64()),
            _one_list(sizes, pa.int64()),
            pa.array([int((sizes > 0).sum())], type=pa.int64()),
            pa.array([int(sizes.sum())], type=pa.int64()),
        ]
        names = ["terms", "counts", "docs", "tfs", "ids", "sizes", "n_docs", "n_terms"]
        return pa.RecordBatch.from_arrays(columns, names=names)


def _one_list(values, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, type=kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], type=pa.int32()), values)


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of an inverted index over all ``doc_id``, ``text`` rows, as a settled table.

    Parquet asks for the size of what it holds after 100 rows, and a row here has megabytes: so it is
    told to ask after each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = SegmentBuilder()
        for batch in batches:
            for doc_id, text in zip(*batch.columns, strict=True):
                segment.add(doc_id.as_py(), text.as_py())
                if segment.full():
                    yield segment.build()
                    segment = SegmentBuilder()
        if segment.ids:
            yield segment.build()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    layout = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1"}
    with small_batches(docs.sparkSession):
        return settle(rows.mapInArrow(run, SEGMENT), **layout)


def query_terms(items: DataFrame) -> DataFrame:
    """``query, item_id, term`` of the distinct terms of each row of ``item_id, text``.

    ``query`` is 0-based, in the order of ids and texts, so that repeated ids are queries of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(text.as_py()))) for text in batch.column(1)]
            terms = pa.array(found, type=pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), terms], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    told = settle(rows.mapInArrow(run, "item_id long, terms array<binary>").where("size(terms) > 0"))
    numbers = Window.orderBy(F.col("item_id").asc_nulls_last(), "digest")
    # One row of two longs per query: the query set is what one user asks at a time.
    keyed = told.withColumn("digest", F.xxhash64("terms"))
    keyed = keyed.withColumn("query", (F.row_number().over(numbers) - 1).cast("long"))
    return settle(keyed.select("query", "item_id", F.explode("terms").alias("term")))


def weighted(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """``asked`` with ``weight``, for terms that some document holds."""
    lists = index.select(F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    wanted = settle(asked.select("term").distinct())
    df = lists.join(wanted, "term").groupBy("term").agg(F.sum("counts").alias("df"))
    odds = F.lit(2.0 * n + 2.0) / (2.0 * F.col("df") + 1.0)
    weight = F.floor(1000.0 * F.ln(odds)).cast("long")
    return settle(asked.join(df, "term").select("query", "item_id", "term", weight.alias("weight")))


class SegmentSearch:
    """One segment as the lists of the terms that a block of queries asks for."""

    def __init__(self, segment: dict, asked: pa.Array, n: int, total: int) -> None:
        self.ids = segment["ids"]
        sizes = segment["sizes"].to_numpy()
        norms = [50 + 50 * int(size) * n // total for size in sizes]
        norm = np.array(norms, dtype=np.int64)
        counts = segment["counts"].to_numpy()
        ends = np.cumsum(counts)
        docs, tfs = segment["docs"].to_numpy(), segment["tfs"].to_numpy().astype(np.int64)
        self.windows = -(-len(sizes) // WINDOW)
        self.lists: dict[int, tuple] = {}
        at = pc.index_in(asked, value_set=segment["terms"])
        for term, place in enumerate(at.to_pylist()):
            if place is None:
                continue
            own = slice(ends[place] - counts[place], ends[place])
            where = docs[own]
            impact = 1_000_000_000 * tfs[own] // (1000 * tfs[own] + 20 * norm[where])
            bounds = None
            if len(where) >= LONG_SHARE * len(sizes):
                edges = np.searchsorted(where, np.arange(self.windows + 1) * WINDOW)
                bounds = np.zeros(self.windows, dtype=np.int64)
                held = edges[:-1] < edges[1:]
                bounds[held] = np.maximum.reduceat(impact, edges[:-1][held])
                bounds = (edges, bounds)
            self.lists[term] = (where, impact, bounds)

    def walk(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer to ``best`` every document that may belong to it."""
        sums = np.zeros(self.windows * WINDOW, dtype=np.int64)
        long_lists = []
        for term, weight in zip(terms.tolist(), weights.tolist(), strict=True):
            if term not in self.lists:
                continue
            where, impact, bounds = self.lists[term]
            if bounds is None:
                sums[where] += weight * impact
            else:
                long_lists.append((where, weight * impact, bounds[0], weight * bounds[1]))
        limits = np.array([sums.reshape(-1, WINDOW).max(axis=1), *(x[3] for x in long_lists)])
        reach = limits.sum(axis=0)
        at = 0
        while True:
            open_windows = np.flatnonzero(reach[at:] >= max(best.least, 1))
            if not len(open_windows):
                return
            at += int(open_windows[0])
            scores = sums[at * WINDOW : (at + 1) * WINDOW]
            rest = int(reach[at] - limits[0, at])
            for i in np.argsort(-limits[1:, at]):
                if int(scores.max()) + rest < best.least:
                    break
                where, worth, edges, own = long_lists[i]
                part = slice(edges[at], edges[at + 1])
                scores[where[part] - at * WINDOW] += worth[part]
                rest -= int(own[at])
            else:
                hits = np.flatnonzero(scores >= max(best.least, 1))
                best.offer(scores[hits], [self.ids[at * WINDOW + int(h)].as_py() for h in hits])
            at += 1


class Best:
    """The highest scores of a query so far, ties to the smaller id, null ids last."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.rows: list[tuple[int, bool, int]] = []
        self.least = 0

    def offer(self, scores: np.ndarray, ids: list[int | None]) -> None:
        fresh = [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids, strict=True)]
        self.rows = sorted(self.rows + fresh)[: self.size]
        if len(self.rows) == self.size:
            self.least = -self.rows[-1][0]


def _segment_by_segment(spark: SparkSession) -> AbstractContextManager[None]:
    """Tasks hold one segment at a time, however many a file has."""
    return small_batches(spark, size="1", rows=1)


def search(index: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` documents of an index for every row of ``item_id, text``.

    Returns ``item_id, rank, doc_id, score``, rank from 1, equal scores by ascending id, null ids
    last. Items without a term that some document holds have no rows; repeated items and documents are
    ranked each for itself. Other columns are ignored. An empty index gives no rows.
    """
    spark = index.sparkSession
    size = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, total = size[0] or 0, size[1] or 0
    asked = query_terms(items)
    with _segment_by_segment(spark):
        asked = weighted(index, asked, n)
    lengths = asked.groupBy("query").agg(F.count("*").alias("length"))
    before = F.sum("length").over(Window.orderBy("query")) - F.col("length")
    blocks = settle(lengths.select("query", F.floor(before / TERMS_TOGETHER).alias("block")))
    last = blocks.agg(F.max("block")).first()[0]
    found = None
    for number in range(0 if last is None else int(last) + 1):
        block = asked.join(blocks.where(F.col("block") == number), "query").drop("block")
        answers = _search_block(index, block, n, total, best)
        with _segment_by_segment(spark):
            answered = settle(answers)
        found = answered if found is None else found.union(answered)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    # First the best of each of many parts, so that no task ranks what all tasks have found.
    part = Window.partitionBy("query", "fan").orderBy(*order)
    fan = F.pmod(F.xxhash64("doc_id", "score"), F.lit(FANS))
    found = found.withColumn("fan", fan).withColumn("place", F.row_number().over(part))
    found = found.where(F.col("place") <= best)
    ranks = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    ranked = found.withColumn("rank", ranks).where(F.col("rank") <= best)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(index: DataFrame, block: DataFrame, n: int, total: int, best: int) -> DataFrame:
    """Each task's best documents for one block of queries, of at most ``TERMS_TOGETHER`` terms and one query."""
    rows = block.orderBy("query").toArrow()
    coded = rows["term"].combine_chunks().dictionary_encode()
    queries, first = np.unique(rows["query"].to_numpy(), return_index=True)
    ends = [*first[1:], len(rows)]
    weights = rows["weight"].to_numpy()
    plan = [
        (q, rows["item_id"][int(a)].as_py(), coded.indices.to_numpy()[a:b], weights[a:b])
        for q, a, b in zip(queries.tolist(), first.tolist(), ends, strict=True)
    ]
    sent = index.sparkSession.sparkContext.broadcast((coded.dictionary, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, plan = sent.value
        tops = [Best(best) for _ in plan]
        for batch in batches:
            for row in range(batch.num_rows):
                parts = {name: batch.column(name)[row].values for name in batch.schema.names}
                segment = SegmentSearch(parts, terms, n, total)
                for top, (_, _, own, worth) in zip(tops, plan, strict=True):
                    segment.walk(own, worth, top)
        found = [
            (query, item, None if no_id else doc, -score)
            for top, (query, item, _, _) in zip(tops, plan, strict=True)
            for score, no_id, doc in top.rows
        ]
        columns = [pa.array([f[i] for f in found], type=pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "item_id", "doc_id", "score"])

    parts = index.select("terms", "counts", "docs", "tfs", "ids", "sizes")
    return parts.mapInArrow(run, "query long, item_id long, doc_id long, score long")


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for every benchmark item.

    Null and empty texts hold no term and are never found; long texts are indexed whole, in slices.
    """
    configure(spark)
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
