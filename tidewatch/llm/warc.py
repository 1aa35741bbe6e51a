"""WARC files and a Merkle audit of their replicas.

Every record is hashed; the hashes of the records that start in a range of offsets, in order, are
hashed to a leaf node, sixteen nodes to the node of a wider range, and so on over offsets and then
over files up to one root. Replicas with equal roots are equal; otherwise only children of nodes
that differ are compared, down to the records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, travels_with_tasks
from tidewatch.session import configure, scratch_root, settle

travels_with_tasks(__name__)

RECORDS_PER_FILE = 1000
# Bytes of the smallest range of a tree, and children of a node.
SPAN = 1 << 16
FAN_OUT = 16
DATE = "2000-01-01T00:00:00Z"

FILES = "path string not null, modificationTime timestamp not null, length long not null, content binary, file long"
RECORD = "file long, offset long, length long, page_id long, digest string"


def warc_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id``, ``file``, ``place`` and ``record``, the WARC record of a page as text.

    A hash of id, address and text deals pages to files of about a thousand, so that one shuffle both
    gathers and orders them. ``place`` orders a file: by id (null first), digest and copy. Null
    addresses and texts are empty; line breaks in addresses become spaces. Repeated rows are numbered
    copies, each a record dealt on its own.
    """
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"))
    tie = F.sha2(F.concat_ws("\n", "url", "html").cast("binary"), 256)
    # Only where ids repeat can rows repeat: ids alone tell, mostly without reading a text.
    if rows.groupBy("page_id").count().where("count > 1").isEmpty():
        rows = rows.select("*", tie.alias("tie"), F.lit(0).cast("long").alias("copy"))
    else:
        first = [F.first(c).alias(c) for c in ("url", "html")]
        rows = rows.groupBy("page_id", tie.alias("tie")).agg(*first, F.count("*").alias("copies"))
        copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
        rows = rows.select("page_id", "url", "html", "tie", copy.alias("copy"))
    files = max(1, -(-pages.count() // RECORDS_PER_FILE))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.col("tie"),
        F.lit(":"),
        F.col("copy").cast("string"),
        F.lit(":"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("html").cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(
        "page_id",
        F.pmod(F.xxhash64("page_id", "tie", "copy"), F.lit(files)).cast("long").alias("file"),
        F.struct("page_id", "tie", "copy").alias("place"),
        F.concat(head, F.col("html"), F.lit("\r\n\r\n")).alias("record"),
    )


def write_warc(records: DataFrame, path: str, replicas: dict[str, Column] | None = None) -> None:
    """One gzipped WARC file per ``file`` in ``path``, records in order of ``place``.

    ``replicas`` gives the text of the record for each of several archives; these are folders
    ``replica=<name>`` of ``path``, all written from one shuffle.
    """
    folders, placed = ["file"], records.repartition("file")
    if replicas:
        texts = [F.struct(F.lit(name).alias("replica"), text.alias("record")) for name, text in replicas.items()]
        placed = placed.select("file", "place", F.inline(F.array(*texts)))
        folders = ["replica", "file"]
    # The text writer ends every line with a line feed: the last byte of each record.
    line = F.expr("substring(record, 1, length(record) - 1)").alias("value")
    lines = placed.sortWithinPartitions(*folders, "place").select(line, *folders)
    lines.write.partitionBy(*folders).option("lineSep", "\n").option("compression", "gzip").text(path)


def parse_records(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record; from a place that is no record, the rest is one."""
    at = 0
    while at < len(content):
        body = content.find(b"\r\n\r\n", at) + 4
        size = -1
        for line in content[at : max(body, at)].split(b"\r\n"):
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                size = int(value)
        whole = content.startswith(b"WARC/", at) and body > 3 and size >= 0
        end = min(body + size + 4, len(content)) if whole else len(content)
        yield at, content[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, length, page_id, digest`` of the records in WARC files, gzipped or not.

    Offsets are those of the unpacked file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import hashlib
        import re

        named = re.compile(rb"<urn:page:[0-9a-f]+:\d+:(-?\d+)>")
        for batch in batches:
            for i in range(batch.num_rows):
                out = []
                content = batch.column("content")[i].as_py()
                if content.startswith(b"\x1f\x8b"):
                    content = gzip.decompress(content)
                for offset, record in parse_records(content):
                    found = named.search(record[: record.find(b"\r\n\r\n")])
                    page = int(found[1]) if found else None
                    digest = hashlib.sha256(record).hexdigest()
                    out.append((batch.column("file")[i].as_py(), offset, len(record), page, digest))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.string()]
                arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                names = ["file", "offset", "length", "page_id", "digest"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    files = spark.read.format("binaryFile").schema(FILES)
    return files.load(path).select("content", "file").mapInArrow(run, RECORD)


def merkle_levels(records: DataFrame, max_file: int, max_offset: int) -> list[DataFrame]:
    """Nodes ``file, part, up_file, up_part, digest`` from the leaf ranges to the root.

    Each node hashes at most the records that start in one range, or ``FAN_OUT`` children.
    """
    steps, span, files = [], 1, 1
    while span * SPAN <= max_offset:
        span *= FAN_OUT
        steps.append((1, FAN_OUT))
    while files <= max_file:
        files *= FAN_OUT
        steps.append((FAN_OUT, 1))

    def node(children: DataFrame, file: Column, part: Column, order: Column) -> DataFrame:
        joined = F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct(order.alias("at"), F.col("digest")))),
                lambda x: F.concat_ws(":", x["at"].cast("string"), x["digest"]),
            ),
            ",",
        )
        grouped = children.groupBy(file.alias("file"), part.alias("part"))
        return grouped.agg(F.sha2(joined.cast("binary"), 256).alias("digest"))

    level = node(records, F.col("file"), F.floor(F.col("offset") / SPAN).cast("long"), F.col("offset"))
    levels = []
    for by_file, by_part in steps:
        up_file = F.floor(F.col("file") / by_file).cast("long")
        up_part = F.floor(F.col("part") / by_part).cast("long")
        level = settle(level.withColumns({"up_file": up_file, "up_part": up_part}))
        levels.append(level)
        level = node(level, F.col("up_file"), F.col("up_part"), F.struct("file", "part").cast("string"))
    root = {"up_file": F.lit(0).cast("long"), "up_part": F.lit(0).cast("long")}
    return [*levels, settle(level.withColumns(root))]


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records that differ between two replicas: ``file, offset, damage``.

    Both have ``file`` (0, 1, ...), ``offset`` and ``digest``; other columns are ignored.
    ``damage`` is ``changed``, ``missing`` (in ``theirs``) or ``added``. A record that moved is
    missing at one offset and added at another. Equal replicas give no rows, as do two empty ones.
    """
    names = ["file", "offset", "digest"]
    ours, theirs = ours.select(*names), theirs.select(*names)
    most = ours.union(theirs).agg(F.max("file"), F.max("offset")).first()
    reach = [value or 0 for value in most]
    trees = [merkle_levels(records, *reach) for records in (ours, theirs)]

    def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        a = a.select(*keys, F.col("digest").alias("ours"))
        b = b.select(*keys, F.col("digest").alias("theirs"))
        return a.join(b, keys, "full").where("not (ours <=> theirs)")

    below = None
    for a, b in zip(*(reversed(tree) for tree in trees), strict=True):
        if below is not None:
            a, b = (x.join(below, ["up_file", "up_part"], "left_semi") for x in (a, b))
        wrong = differing(a, b, ["file", "part"])
        below = settle(wrong.select(F.col("file").alias("up_file"), F.col("part").alias("up_part")))
    part = F.floor(F.col("offset") / SPAN).cast("long")
    spots = below.toDF("file", "part")
    a, b = (
        x.withColumn("part", part).join(spots, ["file", "part"], "left_semi") for x in (ours, theirs)
    )
    damage = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "added")
    found = differing(a, b, ["file", "offset"])
    return found.select("file", "offset", damage.otherwise("changed").alias("damage"))


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages twice, one copy with a wrong date in some records, and find those."""
    configure(spark)
    records = warc_records(table(spark, sf_dir, "pages"))
    wrong = F.replace("record", F.lit("WARC-Date: 2000-01-01"), F.lit("WARC-Date: 2000-01-07"))
    rotten = F.when(F.col("place.page_id") % 97 == 5, wrong).otherwise(F.col("record"))
    root = f"{scratch_root(spark)}/settled/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_warc(records, root, {"ours": F.col("record"), "theirs": rotten})
    replicas = [settle(read_warc(spark, f"{root}/replica={name}")) for name in ("ours", "theirs")]
    found = audit(*replicas)
    return replicas[0].join(found, ["file", "offset"], "left").select(
        "page_id", "file", "offset", "length", F.col("digest").alias("sha256"), "damage"
    )
