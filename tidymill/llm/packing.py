"""Best-fit packing of token sequences, online and in bounded space.

A document is its token ids and an end id. If longer than a sequence it is cut into pieces of full length, of which only the
first may be shorter. Every task packs the pieces it reads batch by batch, the longest of a batch first: at most OPEN_BINS sequences are open, found through a
bitset of the free spaces that occur (the lowest set bit from the piece's length on is the best fit), and if one more must be
opened, the fullest closes. A piece knows its sequence and offset when it is placed, so no batch is held back.

The pieces of sequences that end up under 31/32 full are packed a second time, the longest first: rows of a few numbers, dealt
out by a hash in groups of about GROUP.

Ids are those of the tokenizer's JSON file as its library gives them by default: the rank file gives those of ordinary text, and an added token of the JSON file
(<|endoftext|>) that a text holds is its own id and parts the text.

Defined results: a null text counts as empty and gives one piece with the end id alone; repeated rows are packed each; ties of
free space go to the sequence opened last; an empty table gives no rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Codec
from .frames import pick, remembered, stored, whole_text

OPEN_BINS = 2048
GROUP = 200_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"
#: Words whose ids a worker remembers.
REMEMBERED = 150_000
RUN_OF_SPACE = regex.compile(r"\s\s\s")


class WordIds(dict):
    """Ids of a word with the space before it, as bytes. A space behind a non-space is a boundary of the pattern whatever stands around it; with white space before it, it still goes to the word behind, unless three stand together."""

    def __init__(self, matches, added: dict[str, int] | None = None):
        super().__init__()
        self.matches = matches
        self.added = {token: np.array([i], dtype="<u4").tobytes() for token, i in (added or {}).items()}
        #: The longest of the added tokens that begin at a place.
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __missing__(self, word):
        found = np.array(self.matches(" " + word), dtype="<u4").tobytes()
        if len(self) < REMEMBERED and len(word) < 64:
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        if self.parts is None or not any(token in text for token in self.added):
            return self.ordinary_ids(text)
        return b"".join(self.added[part] if k % 2 else self.ordinary_ids(part) for k, part in enumerate(self.parts.split(text)))

    def ordinary_ids(self, text: str) -> bytes:
        if RUN_OF_SPACE.search(text):
            return np.array(self.matches(text), dtype="<u4").tobytes()
        first, *words = text.split(" ")
        return np.array(self.matches(first), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, words))


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file. Those that match only beside or with white space are not known here."""
    with open(json_path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("an added token that is not matched as it stands")
    return {t["content"]: t["id"] for t in found}


def word_ids(ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> WordIds:
    return remembered(("word ids", ranks_path, pattern, tuple((added or {}).items())), lambda: WordIds(Codec(ranks_path, pattern).matches, added))


class OpenBins:
    """Open sequences by their free space. `place` returns the number of the sequence and the offset in it."""

    def __init__(self, capacity: int, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.by_space: dict[int, list[int]] = {}
        self.bits = self.count = self.opened = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        self.count -= 1
        if not bins:
            self.bits &= ~(1 << space)
        return found

    def _put(self, number: int, space: int) -> None:
        if space:
            self.by_space.setdefault(space, []).append(number)
            self.bits |= 1 << space
            self.count += 1

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting and length:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.opened
            self.opened += 1
        self._put(number, space - length)
        if self.count > self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.capacity - space


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many ids."""
    first = total if total <= capacity else total % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def pack(df: DataFrame, ranks_path: str, pattern: str, capacity: int = 1024, end_id: int = 2, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. added: tokens that are matched in texts, with their ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        words, bins, base = word_ids(ranks_path, pattern, added), OpenBins(capacity), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = words.ids(text) + end
                    rows += [(doc, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])) for k, (start, length) in enumerate(cut(len(ids) // 4, capacity))]
            rows.sort(key=lambda r: -r[3])
            placed = [bins.place(r[3]) for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), TYPES)), pa.array([base | n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=NAMES)

    docs = pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    pieces = stored(docs.mapInArrow(run, SCHEMA), "pieces")
    filled = pieces.withColumn("fill", F.sum("length").over(Window.partitionBy("bin")))
    least = capacity - capacity // 32
    kept = filled.filter(F.col("fill") >= least).drop("fill")
    return kept.unionByName(packed_again(filled.filter(F.col("fill") < least).drop("fill"), capacity)).withColumnRenamed("bin", "sequence_id")


def packed_again(loose: DataFrame, capacity: int) -> DataFrame:
    """The pieces of unfilled sequences in new ones, the longest pieces first."""
    def run(batches):
        bins, base = OpenBins(capacity, 4 * OPEN_BINS), (1 << 62) | TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([base | n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=NAMES)

    groups = max(1, -(-loose.count() // GROUP))
    key = F.xxhash64("doc_id", "piece", "bin", "offset")
    return loose.repartition(groups, key).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "bin", "offset").select(*NAMES).mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
