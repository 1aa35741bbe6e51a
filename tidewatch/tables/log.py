"""Tables of states: a compacted snapshot and a tail of newer states, merged when read.

Every append is a part, a folder of its own, so writers need not wait for each other. A part holds states
of keys; ``merge`` makes one state of all states of a key. Merging a state twice, or in any order, changes
nothing. So parts may be put together at any time and a job that dies in between does no harm: the old
parts are marked after the new one is complete, and until then both are read.

What is read is one state per key and a short tail, not the history: small parts are merged once there are
``MERGE_AT`` of them, and together with the large ones when they make up a quarter of the bytes. Rows carry
the first two characters of their stream id, by which parts are sorted; a reader that knows its streams
reads only row groups with those.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGE_AT = 32
LARGE_PART = 64 << 20
REWRITE_SHARE = 0.25
# Parts that were merged are kept so long for readers that planned before.
GRACE_SECONDS = 3600
# Stream ids are hexadecimal digests, so there are no more buckets.
BUCKETS = 256
MERGED = "_MERGED"


@dataclass(frozen=True)
class Part:
    path: str
    size: int
    merged_at: float | None


def buckets(streams: DataFrame) -> list[str] | None:
    """The buckets ``streams.stream_id`` falls into; none if there are too many to be of use."""
    found = streams.select(F.left("stream_id", F.lit(2)).alias("bucket")).distinct()
    listed = [row["bucket"] for row in found.limit(BUCKETS + 1).collect()]
    return None if len(listed) > BUCKETS or None in listed else listed


class StateLog:
    """One table of states in one folder; ``merge`` maps states to one state per key."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        keys: Sequence[str],
        merge: Callable[[DataFrame], DataFrame],
    ) -> None:
        self.spark = spark
        self.path = path
        self.schema = T.StructType.fromDDL(schema)
        self.keys = list(keys)
        self.merge = merge
        self._stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.StringType())])

    def _hadoop_path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join(names))

    def _fs(self):
        return self._hadoop_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self, merged: bool = False) -> list[Part]:
        """Complete parts; with ``merged`` those that other parts have taken in."""
        fs, root = self._fs(), self._hadoop_path(self.path)
        if not fs.exists(root):
            return []
        found = []
        for status in fs.listStatus(root):
            path = status.getPath().toString()
            files = {f.getPath().getName(): f for f in fs.listStatus(status.getPath())}
            if "_SUCCESS" not in files:
                continue
            mark = files.get(MERGED)
            if (mark is not None) == merged:
                size = sum(f.getLen() for f in files.values())
                found.append(Part(path, size, mark.getModificationTime() / 1000 if mark else None))
        return found

    def _scan(self, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*paths)

    def states(self, among: Sequence[str] | None = None) -> DataFrame:
        """The states of all keys, or of those in the buckets ``among``, not merged yet."""
        rows = self._scan([part.path for part in self.parts()])
        if among is not None:
            rows = rows.where(F.col("bucket").isin(list(among)))
        return rows.drop("bucket")

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _fit(self, rows: DataFrame) -> DataFrame:
        fitted = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        return fitted.withColumn("bucket", F.left("stream_id", F.lit(2)))

    def append(self, rows: DataFrame) -> DataFrame:
        """Write states as one part; returns what was written."""
        path = self._write(self._fit(rows))
        self.compact()
        return self._scan([path]).drop("bucket")

    def compact(self, everything: bool = False, grace_seconds: float = GRACE_SECONDS) -> None:
        """Put parts together once many are small, or all of them if told so."""
        parts = self.parts()
        small = [part for part in parts if part.size < LARGE_PART]
        if not everything and len(small) < MERGE_AT:
            return
        of_small = sum(part.size for part in small)
        whole = everything or of_small >= REWRITE_SHARE * sum(part.size for part in parts)
        chosen = parts if whole else small
        if chosen:
            one = self._fit(self.merge(self._scan([part.path for part in chosen]).drop("bucket")))
            # The key after the bucket: a stream with many keys is cut into several files.
            order = ["bucket", *self.keys]
            self._write(one.repartitionByRange(*order).sortWithinPartitions(*order))
        fs = self._fs()
        for part in chosen:
            fs.create(self._hadoop_path(part.path, MERGED), True).close()
        for part in self.parts(merged=True):
            if part.merged_at <= time.time() - grace_seconds:
                fs.delete(self._hadoop_path(part.path), True)
