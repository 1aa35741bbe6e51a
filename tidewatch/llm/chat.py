"""Format conversations and mask what a model should learn from them.

A conversation is rendered as one text and encoded once, with the offsets of its tokens. Turn spans
and token spans are both sorted, so a binary search finds the tokens of every assistant turn. Turn
markers are special tokens of the vocabulary: no token crosses the border of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, travels_with_tasks
from tidewatch.session import configure

travels_with_tasks(__name__)

START, MIDDLE, STOP = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"
TOKENIZER = "byte_bpe_50k.json"
# Conversations whose tokens are held at once.
ENCODED_TOGETHER = 32

SCHEMA = (
    "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, "
    "mask array<boolean>"
)
PARSED = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str) -> str:
    """No escaped text contains ``<|``, so none contains a marker."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The conversation as one text, and the spans of the texts to learn from, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, STOP)
        at += len(head) + len(body) + len(STOP)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, text = turn[: -len(STOP)].split(MIDDLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def overlapping(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which of the sorted tokens overlap any of the sorted, disjoint spans."""
    mask = np.zeros(len(starts) + 1, dtype=np.int64)
    spans = spans[spans[:, 1] > spans[:, 0]]
    np.add.at(mask, np.searchsorted(ends, spans[:, 0], side="right"), 1)
    np.add.at(mask, np.searchsorted(starts, spans[:, 1], side="left"), -1)
    return np.cumsum(mask[:-1]) > 0


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """Text under the mask; the several tokens of one character count once."""
    parts, at = [], 0
    for a, b in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        if b > at:
            parts.append(formatted[max(a, at) : b])
            at = b
    return "".join(parts)


def load_tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([START, MIDDLE, STOP])
    # Leading spaces belong to their tokens, or the mask would lose them.
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def format_conversations(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: its text, token ids, token offsets and loss mask.

    ``conversations`` has ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored. Rows
    are ordered by turn (nulls first), then role and text, so ties and repeated rows give the same
    result every time; each row is a turn. A null role or text is empty. Rows with a null ``conv_id``
    form one conversation. Offsets are code points of ``formatted``. A conversation is one row, so it
    must fit one task; texts may be of any length.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path(TOKENIZER)
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = (
        conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            F.transform("turns", lambda t: t["role"]).alias("roles"),
            F.transform("turns", lambda t: t["text"]).alias("texts"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = load_tokenizer(path)
        kinds = [pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
        names = ["conv_id", "formatted", "ids", "starts", "ends", "mask"]
        for batch in batches:
            for i in range(0, batch.num_rows, ENCODED_TOGETHER):
                part = batch.slice(i, ENCODED_TOGETHER)
                rendered = [
                    render(list(zip(roles, texts, strict=True)))
                    for roles, texts in zip(
                        part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True
                    )
                ]
                columns: list[list] = [part.column(0).to_pylist(), [], [], [], [], []]
                for text, spans in rendered:
                    got = encoder.encode(text, add_special_tokens=False)
                    offsets = np.array(got.offsets, dtype=np.int32).reshape(-1, 2)
                    starts, ends = offsets[:, 0], offsets[:, 1]
                    values = (text, np.array(got.ids, dtype=np.int32), starts, ends,
                              overlapping(starts, ends, spans))
                    for column, value in zip(columns[1:], values, strict=True):
                        column.append(value)
                arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return grouped.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the learned text, from formatted conversations alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = batch.column("formatted")[i].as_py()
                starts, ends, mask = (
                    batch.column(name)[i].values.to_numpy(zero_copy_only=False)
                    for name in ("starts", "ends", "mask")
                )
                turns = parse(text)
                learned = unescape(masked_text(text, starts, ends, mask.astype(bool)))
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                out.append({
                    "conv_id": batch.column("conv_id")[i].as_py(),
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "loss_chars": len(learned),
                    "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
                    "formatted_chars": len(text),
                })
            if out:
                yield pa.RecordBatch.from_pylist(out)

    wanted = formatted.select("conv_id", "formatted", "starts", "ends", "mask")
    return wanted.mapInArrow(run, PARSED)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema
    )
    return read_back(format_conversations(given.unionByName(extra)))
