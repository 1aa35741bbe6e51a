"""Phrase collocations by dynamic itemset counting.

Brin, Motwani, Ullman and Tsur, "Dynamic Itemset Counting and Implication Rules for Market Basket
Data" (1997). The corpus is dealt to shards, which are scanned in a cycle. All lengths are counted in
the same scan: after a scan, a longer phrase becomes active once the phrases without its last and
without its first word have both reached the threshold, and it is counted from the next shard on until
it has seen every shard once. Counting ends when no active phrase has a shard left to see.

Tasks learn what is active from a table of fixed size, in which a hash of a phrase finds the first and
the last scan at which phrases with this hash reached the threshold. A phrase may thus be counted
too early or too often, never too little: its first full cycle gives the exact number, and of several
cycles the largest number is that of a full one. Counts meet by a digest of 77 bits and the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, table, travels_with_tasks
from tidewatch.session import configure, discard, settle

travels_with_tasks(__name__)

LENGTHS = 4
AT_LEAST = 30
COVERED = 80
BEST = 2000
SHARDS = 2
NO_LANG = "und"
# Tokens of a block; with a slice more, its vocabulary stays below 2^21 and three words fit 63 bits.
BLOCK_TOKENS = 900_000
HELD_TOKENS = 1_800_000
SLICE_BYTES = 1 << 19
# Entries of the table that tells tasks what is active; sent whole, two bytes each.
SLOT_BITS = 23
NEVER = 255
FANS = 256
# Blocks, in sixteenths, that tell the texts of phrases: what a few have told, the rest need not.
TOLD_IN = ((0, 1), (1, 4), (4, 16))
# Phrases a task remembers to have told; beyond it forgets them and may tell one again.
REMEMBERED = 1_000_000

# Signs that end a piece, and white space between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
LETTERS = bytes(
    44 if i in PIECE_ENDS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256)
)

BLOCKS = (
    "turn int, shard int, lang string, lead int, n_words long, words array<binary>, lanes array<long>, "
    "codes array<int>"
)
COUNTS = "h1 long, h2 int, fresh long"


class BlockBuilder:
    """Tokens of one language as codes of a dictionary of their own; -1 ends a piece."""

    def __init__(self, lead: list[bytes] | None = None) -> None:
        self.lead = len(lead or ())
        self.size = 0
        self._tokens = list(lead or ())
        self._parts: list[tuple[pa.Array, np.ndarray]] = []

    def add(self, tokens: list[bytes]) -> None:
        self.size += len(tokens)
        self._tokens += tokens
        if len(self._tokens) > 50_000:
            self._encode()

    def _encode(self) -> None:
        coded = pa.array(self._tokens, type=pa.binary()).dictionary_encode()
        self._parts.append((coded.dictionary, coded.indices.to_numpy()))
        self._tokens = []

    def build(self) -> tuple[pa.Array, np.ndarray]:
        self._encode()
        merged = pa.chunked_array([part[0] for part in self._parts]).combine_chunks()
        merged = merged.dictionary_encode()
        own, at, codes = merged.indices.to_numpy(), 0, []
        for dictionary, indices in self._parts:
            codes.append(own[at : at + len(dictionary)][indices])
            at += len(dictionary)
        found, words = np.concatenate(codes), merged.dictionary
        end = words.index(pa.scalar(b",", type=pa.binary())).as_py()
        if end >= 0:
            words = pa.concat_arrays([words[:end], words[end + 1 :]])
            found = np.where(found == end, -1, found - (found > end))
        return words, found.astype(np.int32)


def blocks_of(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All words of ``lang, text`` as blocks of codes, dealt to shards; a settled table.

    Each task deals the blocks of what it reads in turn. A block ends between documents, or inside
    one longer than a block: then the next begins with up to three words that it does not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        turn = context.partitionId() if context else 0
        held: dict[str, BlockBuilder] = {}

        def row(lang: str, block: BlockBuilder) -> pa.RecordBatch:
            nonlocal turn
            words, codes = block.build()
            turn += 1
            counted = int((codes[block.lead :] >= 0).sum())
            lanes = word_digests(lang, words)
            lists = [pa.array([0, len(x)], type=pa.int32()) for x in (words, lanes, codes)]
            columns = [
                pa.array([turn], type=pa.int32()),
                pa.array([turn % shards], type=pa.int32()),
                pa.array([lang]),
                pa.array([block.lead], type=pa.int32()),
                pa.array([counted], type=pa.int64()),
                pa.ListArray.from_arrays(lists[0], words),
                pa.ListArray.from_arrays(lists[1], pa.array(lanes)),
                pa.ListArray.from_arrays(lists[2], pa.array(codes)),
            ]
            names = ["turn", "shard", "lang", "lead", "n_words", "words", "lanes", "codes"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for lang, text in zip(*batch.columns, strict=True):
                lang, tail = lang.as_py(), []
                rest = (text.as_py() or "").encode().translate(LETTERS).replace(b",", b" , ")
                start = 0
                while start < len(rest):
                    end = rest.find(b" ", start + SLICE_BYTES)
                    end = len(rest) if end < 0 else end
                    tokens = rest[start:end].split()
                    block = held.setdefault(lang, BlockBuilder())
                    block.add(tokens)
                    tail = (tail + tokens)[-(LENGTHS - 1) :]
                    if b"," in tail:
                        tail = tail[len(tail) - tail[::-1].index(b",") :]
                    if block.size >= BLOCK_TOKENS:
                        yield row(lang, held.pop(lang))
                        if end < len(rest):
                            held[lang] = BlockBuilder(tail)
                    start = end
                if lang in held:
                    held[lang].add([b","])
                if sum(block.size for block in held.values()) >= HELD_TOKENS:
                    for name in list(held):
                        yield row(name, held.pop(name))
        for name, block in held.items():
            yield row(name, block)

    rows = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    return settle(rows.mapInArrow(run, BLOCKS))


def word_digests(lang: str, words: pa.Array) -> np.ndarray:
    """128 bits of each word of a language: the first halves, then the second."""
    from xxhash import xxh3_128_digest

    start = lang.encode() + b"\t"
    digests = b"".join(xxh3_128_digest(start + word) for word in words.to_pylist())
    return np.frombuffer(digests, dtype="<i8").reshape(-1, 2).T.ravel()


def _packed(*tables: np.ndarray) -> bytes:
    return zlib.compress(b"".join(table.tobytes() for table in tables), 1)


def _unpacked(sent: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sent), dtype=np.uint8).reshape(-1, 1 << SLOT_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longer(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Digest of a phrase with one word more."""
    return _mixed(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


def _digest_columns(n: int, one: np.ndarray, two: np.ndarray) -> list[pa.Array]:
    """``h1``, and as ``h2`` 13 bits more and the number of words."""
    short = ((two >> np.uint64(51)) << np.uint64(3)) | np.uint64(n)
    return [pa.array(one.view(np.int64)), pa.array(short.astype(np.uint32).view(np.int32))]


class Block:
    """Phrases of one block that may be active or may have reached the threshold."""

    def __init__(self, lead: int, lanes: np.ndarray, codes: np.ndarray) -> None:
        self.lead = lead
        self.codes = codes.astype(np.int64)
        self.lanes = lanes.view(np.uint64).reshape(2, -1)
        self.counts = np.bincount(self.codes[lead:] + 1, minlength=self.lanes.shape[1] + 1)[1:]

    def word_lane(self, lane: int, at: np.ndarray) -> np.ndarray:
        return self.lanes[lane][self.codes[at]]

    def digest(self, n: int, at: np.ndarray) -> list[pa.Array]:
        """Digests of the phrases of ``n`` words that start at ``at``."""
        lanes = []
        for lane in (0, 1):
            value = self.word_lane(lane, at)
            for k in range(1, n):
                value = _longer(value, self.word_lane(lane, at + k))
            lanes.append(value)
        return _digest_columns(n, *lanes)

    def walk(self, first: np.ndarray, last: np.ndarray) -> Iterator[tuple]:
        """``n``, starts of phrases whose parts may have reached, the first and the last scan at which
        their parts may have, and the phrases' own entries of the table."""
        codes, mask = self.codes, np.uint64((1 << SLOT_BITS) - 1)
        slots = self.lanes[0] & mask
        none = np.array([NEVER], dtype=np.uint8)
        lo, hi = np.append(first[slots], none)[codes], np.append(last[slots], none)[codes]
        lane = np.append(self.lanes[0], np.uint64(0))[codes]
        for n in range(2, LENGTHS + 1):
            parts_lo, parts_hi = np.maximum(lo[:-1], lo[1:]), np.maximum(hi[:-1], hi[1:])
            at = np.flatnonzero(parts_lo < NEVER)
            at = at[at + n <= len(codes)]
            value = _longer(lane[at], self.word_lane(0, at + n - 1))
            own = value & mask
            lo, hi = (np.full(len(codes), NEVER, dtype=np.uint8) for _ in range(2))
            lo[at], hi[at] = first[own], last[own]
            lane = np.zeros(len(codes), dtype=np.uint64)
            lane[at] = value
            yield n, at, parts_lo[at], parts_hi[at], own

    def distinct(self, n: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of phrases that end after the lead: where each first stands, and how often."""
        at = at[at + n - 1 >= self.lead]
        codes, base = self.codes, self.lanes.shape[1]
        key = codes[at] * base + codes[at + 1]
        if n > 2:
            key = key * base + codes[at + 2]
        if n > 3:
            key = np.unique(key, return_inverse=True)[1] * base + codes[at + 3]
        _, where, counts = np.unique(key, return_index=True, return_counts=True)
        return at[where], counts


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, list]]:
    """Blocks of ``lead, lanes, codes``, and what other columns there are."""
    for batch in batches:
        for lead, lanes, codes, *rest in zip(*batch.columns, strict=True):
            yield Block(lead.as_py(), lanes.values.to_numpy(), codes.values.to_numpy()), rest


def _scan(shard: DataFrame, active, scan: int, shards: int) -> DataFrame:
    """Counts in one shard of all phrases that may be active in this scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = _unpacked(active.value)

        def rows(digests: list[pa.Array], counts: np.ndarray) -> pa.RecordBatch:
            columns = [*digests, pa.array(counts.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "fresh"])

        for block, _ in _each_block(batches):
            if scan < shards:
                held = np.flatnonzero(block.counts)
                yield rows(_digest_columns(1, *block.lanes[:, held]), block.counts[held])
            for n, at, lo, hi, _ in block.walk(first, last):
                due = (lo < scan) & (scan <= hi.astype(np.int64) + shards)
                where, counts = block.distinct(n, at[due])
                if len(where):
                    yield rows(block.digest(n, where), counts)

    return shard.select("lead", "lanes", "codes").mapInArrow(run, COUNTS)


def _texts(blocks: DataFrame, active) -> DataFrame:
    """``h1, h2, lang, phrase`` of all phrases that may be wanted, about once a task."""
    kinds = "h1 long, h2 int, lang string, phrase string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, wanted = _unpacked(active.value)
        mask = np.uint64((1 << SLOT_BITS) - 1)

        def rows(lang: str, digests: list[pa.Array], phrases: list[str]) -> pa.RecordBatch:
            langs = pa.array([lang] * len(phrases), type=pa.string())
            columns = [*digests, langs, pa.array(phrases, type=pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["h1", "h2", "lang", "phrase"])

        told: set[tuple[int, int]] = set()

        def fresh(digests: list[pa.Array]) -> list[int]:
            """Places of digests that were not told yet."""
            if len(told) > REMEMBERED:
                told.clear()
            keys = list(zip(*(d.to_pylist() for d in digests), strict=True))
            places = [i for i, key in enumerate(keys) if key not in told]
            told.update(keys)
            return places

        for block, (name, held_words) in _each_block(batches):
            lang = name.as_py()
            words = [word.decode() for word in held_words.values.to_pylist()]
            held = np.flatnonzero(wanted[block.lanes[0] & mask])
            untold = fresh(_digest_columns(1, *block.lanes[:, held]))
            held = held[untold]
            yield rows(lang, _digest_columns(1, *block.lanes[:, held]), [words[i] for i in held])
            for n, at, _, _, own in block.walk(first, last):
                where, _ = block.distinct(n, at[wanted[own] > 0])
                where = where[fresh(block.digest(n, where))]
                said = [" ".join(words[c] for c in block.codes[i : i + n]) for i in where.tolist()]
                yield rows(lang, block.digest(n, where), said)

    return blocks.select("lead", "lanes", "codes", "lang", "words").mapInArrow(run, kinds)


def _new_slots(reached: DataFrame) -> np.ndarray:
    """Slots of newly reached phrases, as bitmaps whose size does not depend on their number."""
    slot = F.col("h1").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    maps = reached.groupBy(F.bitmap_bucket_number(slot + 1).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits")
    )
    found = [np.zeros(0, dtype=np.int64)]
    for row in maps.collect():
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little")
        found.append(np.flatnonzero(bits) + (row["part"] - 1) * len(bits))
    return np.concatenate(found)


def frequent_phrases(docs: DataFrame, at_least: int = AT_LEAST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """``lang, n, phrase, f`` of all phrases of up to four words that occur ``at_least`` times, and
    ``lang, words``, the number of word occurrences of each language."""
    spark = docs.sparkSession
    blocks = blocks_of(docs, shards)
    first, last = (np.full(1 << SLOT_BITS, NEVER, dtype=np.uint8) for _ in range(2))
    kinds = "h1 long, h2 int, total long"
    state, done, scan, end = None, spark.createDataFrame([], kinds), 0, shards - 1
    while scan <= end:
        active = spark.sparkContext.broadcast(_packed(first, last))
        counts = _scan(blocks.where(F.col("shard") == scan % shards), active, scan, shards)
        rows = counts.select("h1", "h2", F.col("fresh").alias("total"), F.lit(scan).alias("born"))
        if state is not None:
            rows = rows.union(state.where(F.col("born") + shards > scan).select(*rows.columns))
        # Nearly all rows of a block are alone, so adding them up before the shuffle gains nothing.
        before = F.sum(F.when(F.col("born") < scan, F.col("total")).otherwise(0))
        merged = rows.repartition("h1").groupBy("h1", "h2").agg(
            before.alias("before"), F.sum("total").alias("total"), F.min("born").alias("born")
        )
        # All shards seen without reaching: never to reach.
        seen_all = F.col("born") + (shards - 1) <= scan
        with small_batches(spark):
            held = settle(merged.where(~seen_all | (F.col("total") >= at_least)))
        active.destroy()
        if state is not None:
            discard(state)
        reached = held.where((F.col("before") < at_least) & (F.col("total") >= at_least))
        # A phrase that was counted too often may reach again: only the first time counts.
        new = settle(reached.join(done, ["h1", "h2"], "left_anti").select("h1", "h2"))
        found = _new_slots(new)
        first[found] = np.minimum(first[found], scan)
        last[found] = scan
        if not new.where(_length() < LENGTHS).isEmpty():
            end = max(end, scan + shards)
        done = done.union(settle(held.where(seen_all).select("h1", "h2", "total")))
        state = held
        scan += 1
        if scan >= NEVER:
            raise RuntimeError("more scans than the table of active phrases can tell apart")
    # Phrases first met late in their cycle: by now every cycle has ended.
    done = done.union(state.where(F.col("total") >= at_least).select("h1", "h2", "total"))
    known = settle(done.groupBy("h1", "h2").agg(F.max("total").alias("f")))
    phrases, untold = None, known
    for low, high in TOLD_IN:
        part = F.floor(F.col("turn") / shards) % TOLD_IN[-1][1]
        wanted = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
        wanted[_new_slots(untold)] = 1
        active = spark.sparkContext.broadcast(_packed(first, last, wanted))
        told = _texts(blocks.where((part >= low) & (part < high)), active).groupBy("h1", "h2")
        told = told.agg(F.any_value("lang").alias("lang"), F.any_value("phrase").alias("phrase"))
        with small_batches(spark):
            named = settle(told.join(untold, ["h1", "h2"]))
        active.destroy()
        phrases = named if phrases is None else phrases.union(named)
        untold = settle(untold.join(named.select("h1", "h2"), ["h1", "h2"], "left_anti"))
    phrases = phrases.select("lang", _length().alias("n"), "phrase", "f")
    discard(state)
    words = settle(blocks.groupBy("lang").agg(F.sum("n_words").alias("words")))
    discard(blocks)
    return phrases, words


def _length() -> Column:
    """Words of a phrase, which its digest ends with."""
    return F.col("h2").bitwiseAND(F.lit(7)).cast("int")


def _cut_score(a: Column, both: Column) -> Column:
    """``floor(2000000 * a / both)`` in whole numbers of 38 digits."""
    wide = F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", wide, both.cast("decimal(20,0)"))


def collocations(docs: DataFrame, at_least: int = AT_LEAST, best: int = BEST, shards: int = SHARDS) -> DataFrame:
    """The ``best`` phrases of two to four words of each language.

    ``docs`` has ``lang`` and ``text``; other columns are ignored. Returns ``lang, rank, phrase, a, l,
    r, n, score``. Null texts are empty, a null language is ``und``; empty texts hold no words; long
    texts are counted whole, in blocks. Repeated rows count again. No frequent phrase, no rows.
    """
    phrases, words = frequent_phrases(docs, at_least, shards)
    plain = phrases.select("lang", "phrase", "f")
    longer = phrases.where("n > 1").withColumnRenamed("f", "a")
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cut = cut.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cut = cut.withColumn("right", F.expr("substring_index(phrase, ' ', k - n)"))
    left = plain.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = plain.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cut = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    cut = cut.withColumn("score", _cut_score(F.col("a"), F.col("l") + F.col("r")))
    worst = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("worst")
    scored = cut.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "worst.*")

    parts = phrases.where("n > 2").withColumn("words", F.split("phrase", " "))
    parts = parts.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    parts = parts.withColumn("at", F.explode(F.expr("sequence(1, n - size + 1)")))
    inside = F.array_join(F.expr("slice(words, at, size)"), " ")
    cover = parts.groupBy("lang", inside.alias("phrase")).agg(F.max("f").alias("cover"))
    kept = scored.join(cover, ["lang", "phrase"], "left")
    covered = F.coalesce("cover", F.lit(0)).cast("decimal(20,0)") * 100
    kept = settle(kept.where(covered < F.col("a").cast("decimal(20,0)") * COVERED).drop("cover"))

    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    part = Window.partitionBy("lang", "fan").orderBy(*order)
    kept = kept.withColumn("fan", F.pmod(F.xxhash64("phrase"), F.lit(FANS)))
    kept = kept.withColumn("place", F.row_number().over(part)).where(F.col("place") <= best)
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = kept.withColumn("rank", ranks).where(F.col("rank") <= best).join(words, "lang")
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        F.col("words").alias("n"), F.col("score").cast("long").alias("score"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return collocations(table(spark, sf_dir, "documents"))
