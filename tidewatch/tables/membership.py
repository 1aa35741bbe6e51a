"""Which batches may hold a key: a Bloom filter and a time range per batch, as rows of one table.

A batch of ``n`` keys has about ``12 n / 64`` words of 64 bits; a key sets four bits of one word. New keys
are joined with the words of batches whose times meet theirs, and only batches where some word has all
four bits are read. An entry is written before its batch, so what is stored is always found; entries of
batches that were never finished only cost a look. Small files of the table are merged as they gather:
entries may be there twice in between, which changes nothing, so writers need not wait for each other.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS_PER_KEY = 12
BITS_SET = 4
# Files are merged when there are so many of less than ``LARGE_FILE`` bytes.
MERGE_AT = 32
LARGE_FILE = 64 << 20

SCHEMA = (
    "batch_id string, first timestamp, last timestamp, words bigint, word bigint, bits bigint"
)


def words_for(n: int) -> int:
    """Words of the filter of ``n`` keys, a power of two."""
    return 1 << max(0, math.ceil(math.log2(max(1, n) * BITS_PER_KEY / 64)))


def _key_hash() -> Column:
    return F.xxhash64("stream_id", "row_fingerprint")


def _word(words: Column) -> Column:
    return F.col("h").bitwiseAND(words - 1)


def _mask() -> Column:
    """The bits a key sets, from the top of its hash."""
    mask = F.lit(0).cast("bigint")
    for i in range(BITS_SET):
        place = F.shiftrightunsigned(F.col("h"), 64 - 6 * (i + 1)).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


class MembershipIndex:
    """The entries of all batches of one table of observations, in one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes of the entry folders, one per write or merge."""
        fs = self._fs()
        if not fs.exists(self._root):
            return []
        found = []
        for status in fs.listStatus(self._root):
            where = status.getPath()
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")):
                found.append((where.toString(), fs.getContentSummary(where).getLength()))
        return found

    def exists(self) -> bool:
        return self._fs().exists(self._root)

    def entries(self) -> DataFrame:
        paths = [path for path, _ in self.files()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(T.StructType.fromDDL(SCHEMA)).parquet(*paths)

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def add(self, rows: DataFrame, batch_id: str, first, last, n: int) -> None:
        """Enter the keys of a batch of at most ``n`` rows, before the batch is written."""
        words = words_for(n)
        hashed = rows.select(_key_hash().alias("h"))
        entry = hashed.groupBy(_word(F.lit(words).cast("bigint")).alias("word")).agg(
            F.bit_or(_mask()).alias("bits")
        )
        self._write(
            entry.select(
                F.lit(batch_id).alias("batch_id"), F.lit(first).alias("first"),
                F.lit(last).alias("last"), F.lit(words).cast("bigint").alias("words"), "word", "bits",
            )
        )
        self.merge()

    def build(self, stored: DataFrame) -> None:
        """Enter batches that were stored before there was an index."""
        spans = stored.groupBy("batch_id").agg(
            F.min("observed_at").alias("first"), F.max("observed_at").alias("last"),
            F.count(F.lit(1)).alias("n"),
        )
        size = F.ceil(F.log2(F.col("n") * F.lit(BITS_PER_KEY / 64)))
        words = F.pow(F.lit(2.0), F.greatest(size, F.lit(0))).cast("bigint")
        hashed = stored.select("batch_id", _key_hash().alias("h"))
        entry = hashed.join(spans.withColumn("words", words), "batch_id")
        entry = entry.groupBy("batch_id", "first", "last", "words", _word(F.col("words")).alias("word"))
        self._write(entry.agg(F.bit_or(_mask()).alias("bits")))

    def candidates(self, rows: DataFrame, first, last) -> list[str]:
        """Batches that may hold a key of ``rows``, whose times lie between ``first`` and ``last``.

        One name per batch reaches the driver, as for any list of folders.
        """
        near = self.entries().where((F.col("last") >= F.lit(first)) & (F.col("first") <= F.lit(last)))
        sizes = [row["words"] for row in near.select("words").distinct().collect()]
        if not sizes:
            return []
        # Powers of two: a few dozen sizes at most, whatever the number of batches.
        asked = rows.select(_key_hash().alias("h")).distinct()
        asked = asked.withColumn("words", F.explode(F.array(*(F.lit(s).cast("bigint") for s in sizes))))
        asked = asked.select("words", _word(F.col("words")).alias("word"), _mask().alias("mask"))
        held = F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")
        hits = near.join(asked, ["words", "word"]).where(held).select("batch_id").distinct()
        return sorted(row["batch_id"] for row in hits.collect())

    def merge(self) -> None:
        """Put small files together once there are many; the old ones go after the new one is there."""
        small = [path for path, size in self.files() if size < LARGE_FILE]
        if len(small) < MERGE_AT:
            return
        kept = self.spark.read.schema(T.StructType.fromDDL(SCHEMA)).parquet(*small)
        # Sorted by time, so that row groups of other times are skipped.
        self._write(kept.distinct().repartitionByRange("first", "batch_id").sortWithinPartitions("first"))
        fs = self._fs()
        for path in small:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
