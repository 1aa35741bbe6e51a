"""Pack tokenized documents into sequences: sum-of-squares online packing.

Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the Sum-of-Squares Algorithm for Bin Packing"
(2006): an item goes to the fill level after which the sum over levels of the squared number of
partially filled sequences is smallest. Each task packs the documents it reads, batch by batch, with
one array of counts by level; nothing is shuffled. At the end of a task the sequences still open are
closed without waste: the pieces of the emptiest are cut to fill the gaps of the fullest, which keep
theirs, and the one left over is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, travels_with_tasks
from tidewatch.session import configure

travels_with_tasks(__name__)

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Parts between white space, and words, whose ids a worker remembers; beyond it forgets them.
REMEMBERED_PARTS = 300_000
REMEMBERED_WORDS = 400_000
ENCODED_TOGETHER = 512
TEXTS_TOGETHER = 256
MEMORY = "packing_memory"
# Signs from U+0080 to U+00BF that may count as letters, digits or spaces in one library only, a
# letter whose lower case is two characters, and all beyond the Latin letters.
SIGNS = re.compile("[\x1c-\x1f\x80-\xbf\xd7\xf7\u0130\u0180-\U0010ffff]")

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, with a memory of what was encoded.

    The vocabulary's own pre-tokenizer never looks across white space. Texts of Latin letters, which
    its normalizer treats letter by letter, are cut there and the parts looked up; any other text is
    left to the library whole. A new part is put together from its words. New words of many texts are
    encoded together as one text, cut at white space only, which the mark of a word's last token takes
    apart again.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence as Unchanged
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self._tokenizer = Tokenizer.from_file(path)
        self._by_word = Tokenizer.from_file(path)
        self._by_word.normalizer = Unchanged([])
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self._by_word.pre_tokenizer = Sequence([WhitespaceSplit(), letters])
        # Fixed value: the word pattern of the vocabulary file, for Latin letters in lower case.
        self._words = re.compile(
            "'(?:s|t|re|ve|m|ll|d)|[a-z\xc0-\u017f]+|[0-9]|[^\\sa-z\xc0-\u017f0-9]+"
        ).findall
        vocabulary = self._tokenizer.get_vocab()
        self._closing = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict[str, bytes] = {}
        self._known_words: dict[str, bytes] = {}

    @staticmethod
    def _simple(text: str) -> bool:
        """Whether all is ASCII or a Latin letter below U+0180, and no special token can occur."""
        return "<|" not in text and not SIGNS.search(text)

    def _learn_words(self, fresh: list[str]) -> None:
        for i in range(0, len(fresh), ENCODED_TOGETHER):
            some = fresh[i : i + ENCODED_TOGETHER]
            got = self._by_word.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(got[0].ids, dtype="<u4")
            ends = np.flatnonzero(self._closing[ids]) + 1
            if len(ends) != len(some):
                raise RuntimeError("words and their tokens do not match")
            packed, start = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist(), strict=True):
                self._known_words[word] = packed[start:end]
                start = end

    def _learn(self, fresh: set[str]) -> None:
        known = self._known_words
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        cut = {part: self._words(part) for part in fresh}
        self._learn_words(list(set().union(*cut.values()).difference(known)))
        for part, words in cut.items():
            self._known[part] = b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [text.lower().split() if self._simple(text) else None for text in texts]
        known = self._known
        if len(known) > REMEMBERED_PARTS:
            known.clear()
        self._learn(set().union(*filter(None, cut)).difference(known))
        out = []
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                ids = self._tokenizer.encode(text, add_special_tokens=False).ids
                out.append(np.array(ids, dtype="<u4").tobytes())
            else:
                out.append(b"".join(map(known.__getitem__, words)))
        return out


def remembered_encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, which keeps what earlier tasks have encoded."""
    memory = sys.modules.setdefault(MEMORY, ModuleType(MEMORY)).__dict__
    if path not in memory:
        memory[path] = WordEncoder(path)
    return memory[path]


class Packer:
    """Sum-of-squares placement with ``counts[level]``, the number of open sequences at a level."""

    def __init__(self, size: int, first_id: int) -> None:
        self.size = size
        self.next_id = first_id
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.out: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, ids, total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.size * 4
        whole = len(ids) // step * step
        for i in range(0, whole, step):
            self._emit([(doc_id, i // 4, ids[i : i + step], total)])
        if whole < len(ids):
            self._place((doc_id, whole // 4, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        counts, size = self.counts, self.size
        # Leaving a level with c open sequences adds 1 - 2c to the sum of squares, and reaching one
        # with d adds 1 + 2d; but level 0 (a new sequence) and a full sequence are not counted.
        change = 2 * (counts[n:] - counts[: size + 1 - n])
        change[0] -= 1
        change[-1] -= 1
        usable = counts[: size + 1 - n] > 0
        usable[0] = True
        level = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        pieces = []
        if level:
            counts[level] -= 1
            pieces = self.open[level].pop()
        pieces.append(piece)
        if level + n == size:
            self._emit(pieces)
        else:
            counts[level + n] += 1
            self.open.setdefault(level + n, []).append(pieces)

    def close(self) -> None:
        """Fill the gaps of the fullest open sequences with the pieces of the emptiest.

        The fullest keep their pieces. Only those of the emptiest move, cut where a gap is smaller.
        """
        levels = [(level, pieces) for level in sorted(self.open) for pieces in self.open[level]]
        first, last = 0, len(levels) - 1
        loose: list[tuple] = []
        while first < last:
            level, filled = levels[last]
            last -= 1
            gap = self.size - level
            while gap:
                if not loose:
                    if first > last:
                        break
                    loose = levels[first][1][::-1]
                    first += 1
                gap -= self._cut(loose, gap, filled)
            if gap:
                loose = filled[::-1]
                break
            self._emit(filled)
        if first == last:
            # The sequence in the middle, and what is left of the one before it.
            loose = levels[first][1][::-1] + loose
        left = sum(len(piece[2]) for piece in loose) // 4
        lengths = [self.size] * (left // self.size)
        left %= self.size
        lengths += [1 << bit for bit in range(left.bit_length() - 1, -1, -1) if left >> bit & 1]
        for length in lengths:
            filled = []
            while length:
                length -= self._cut(loose, length, filled)
            self._emit(filled)
        self.open.clear()
        self.counts[:] = 0

    @staticmethod
    def _cut(loose: list[tuple], gap: int, filled: list[tuple]) -> int:
        """Move at most ``gap`` tokens of the last loose piece, and say how many."""
        doc_id, start, ids, total = loose.pop()
        n = min(gap, len(ids) // 4)
        filled.append((doc_id, start, ids[: 4 * n], total))
        if 4 * n < len(ids):
            loose.append((doc_id, start + n, ids[4 * n :], total))
        return n

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[] for _ in range(7)]
        self.out = []
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Token pieces of ``doc_id``, ``text`` and the sequences and offsets they are packed at.

    A document is its token ids and then id 1; null text is empty, so it is that one id. Other
    columns are ignored. Returns ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``;
    ``ids`` are little-endian unsigned 32-bit numbers. Documents longer than ``size`` fill whole
    sequences first. Sequences have ``size`` tokens, or a power of two at the end of a task. Repeated
    rows and null ids are packed like any others. ``size`` must be a power of two.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        encoder = remembered_encoder(path)
        packer = Packer(size, (context.partitionId() if context else 0) << 40)
        end = np.array([END_ID], dtype="<u4").tobytes()
        held = 0
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS_TOGETHER):
                part = batch.slice(i, TEXTS_TOGETHER)
                texts = [text or "" for text in part.column(1).to_pylist()]
                for doc_id, ids in zip(
                    part.column(0).to_pylist(), encoder.encode(texts), strict=True
                ):
                    packer.add(doc_id, ids + end)
                    held += len(ids)
                if held > 4_000_000:
                    yield packer.take()
                    held = 0
        packer.close()
        yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return packed_rows(pack(table(spark, sf_dir, "documents")))


def packed_rows(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
