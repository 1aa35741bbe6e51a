"""SimHash near-duplicates through pivot distance tables.

Every fingerprint gets its Hamming distances to fixed reference fingerprints (pivots). Distances to a
pivot differ by at most the distance of two fingerprints, so a pair with a larger difference in any
coordinate is discarded unseen, and only survivors are compared bit by bit. Pairs to look at come
from equi-joins: fingerprints that differ in at most two bits agree on all but two of some blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, travels_with_tasks
from tidewatch.llm.components import connected_components
from tidewatch.session import configure, settle

travels_with_tasks(__name__)

SEED = 42
SHINGLE = 3
DISTANCE = 2
PIVOTS = 16
BLOCKS = 4
# A block pair shared by more fingerprints than this is searched by probes: there are 528 of them
# per fingerprint, fewer than half the partners a larger group would offer.
PROBED_ABOVE = 1024


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text, in order, at most 65,536 at a time.

    ``bytes.lower`` and ``bytes.split`` treat exactly A-Z and the six ASCII white spaces.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(len(word) + 1 for word in words))
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    for i in range(0, len(last), 65536):
        spans = zip(starts[i : i + 65536], last[i : i + 65536], strict=False)
        yield np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")


def bits_of(blocks: Iterable[np.ndarray]) -> int:
    """The bits set in over half the hashes, as a signed number; 0 of none."""
    total, set_bits = 0, np.zeros(64, dtype=np.int64)
    for hashes in blocks:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    packed = np.packbits(set_bits * 2 > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed number."""
    return bits_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a long, of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, type=pa.int64())], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_table(prints: DataFrame) -> DataFrame:
    """Add ``p0`` and ``p1``: the distances of ``fp`` to the pivots, eight to a long, a byte each."""
    pivots = [F.xxhash64(F.lit(i)) for i in range(PIVOTS)]
    near = [F.bit_count(F.col("fp").bitwiseXOR(pivot)).cast("long") for pivot in pivots]

    def packed(distances: list[Column]) -> Column:
        value = distances[0]
        for i, distance in enumerate(distances[1:], 1):
            value = value.bitwiseOR(F.shiftleft(distance, 8 * i))
        return value

    return prints.withColumns({"p0": packed(near[:8]), "p1": packed(near[8:])})


def pivots_allow(distance: int) -> str:
    """Largest coordinate difference at most ``distance``."""
    terms = [
        f"abs((shiftright(a.{p}, {8 * i}) & 127) - (shiftright(b.{p}, {8 * i}) & 127)) <= {distance}"
        for p in ("p0", "p1")
        for i in range(8)
    ]
    return " and ".join(terms)


def _block_masks() -> list[int]:
    width = 64 // BLOCKS
    blocks = [((1 << width) - 1) << (width * i) for i in range(BLOCKS)]
    return [sum(kept) for kept in combinations(blocks, BLOCKS - DISTANCE)]


def links(prints: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints ``fp`` that differ in at most two bits."""
    tagged = F.array(
        *(
            F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for t, mask in enumerate(_block_masks())
        )
    )
    rows = pivot_table(prints).select("fp", "p0", "p1", F.inline(tagged))
    sizes = rows.groupBy("tag", "key").agg(F.count("*").alias("n"))
    crowded = settle(sizes.where(F.col("n") > PROBED_ABOVE).select("tag", "key"))
    shared = rows.join(crowded, ["tag", "key"], "left_anti")
    a, b = shared.alias("a"), shared.alias("b")
    same = F.expr(
        f"a.tag = b.tag and a.key = b.key and a.fp < b.fp and {pivots_allow(DISTANCE)} "
        f"and bit_count(a.fp ^ b.fp) <= {DISTANCE}"
    )
    found = a.join(b, same).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    # In a crowded block pair, every fingerprint within reach is looked up by its value.
    flips = []
    for mask in _block_masks():
        free = [i for i in range(64) if not mask >> i & 1]
        one = [1 << i for i in free]
        two = [x | y for x, y in combinations(one, 2)]
        flips.append(F.array(*(F.lit(_signed(x)) for x in one + two)))
    hot = rows.join(crowded, ["tag", "key"], "left_semi").select("fp", "tag")
    reach = F.explode(F.element_at(F.array(*flips), F.col("tag") + 1))
    probes = hot.select("fp", reach.alias("flip"))
    probes = probes.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b"))
    probes = probes.where("a < b").join(prints.select(F.col("fp").alias("b")), "b")
    return found.union(probes.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprint and component of every document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Returns ``doc_id``, ``fp`` and
    ``component_id``, the smallest id that links of at most two bits reach. Equal fingerprints are
    one node, so copies are never paired. Null, empty and blank texts have fingerprint 0, which links
    like any other. A null id gets a component, but names one only if no other id is in it (null).
    Repeated rows give repeated results. No rows give no rows.
    """
    prints = settle(fingerprints(docs, shingle))
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    grouped = connected_components(links(nodes.select("fp")))
    placed = nodes.join(grouped, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("component", "fp").alias("root")
    )
    roots = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = settle(placed.join(roots, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest id.

    Rows with a null id stay, since nothing names them. Of repeated rows of a kept document one
    stays.
    """
    found = near_duplicates(docs, shingle)
    dropped = settle(found.where("doc_id != component_id").select("doc_id").distinct())
    kept = docs.join(dropped, "doc_id", "left_anti")
    columns = [F.col(name) for name in docs.columns]
    repeated = settle(
        found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1")
    )
    if repeated.isEmpty():
        return kept.select(*columns)
    once = kept.join(repeated, "doc_id", "left_anti").select(*columns)
    several = kept.join(repeated, "doc_id", "left_semi").select(*columns)
    return once.union(several.dropDuplicates(["doc_id"]))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
