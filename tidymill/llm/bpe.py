"""Byte-level BPE as a monoid: a text is encoded half by half, and the encodings of neighbours are joined.

An element is a stretch of text with its token ids. Joining two stretches takes back only what lies between the last place
before the seam and the first place behind it that are certain to end a match of the pattern, and encodes that window again.
A place is certain if it lies between a letter or digit and white space or punctuation: no match of the pattern covers both.
If there is no such place near the seam, the window grows. If the window is one match and very long, it is joined token by token:
tokens left and right of the seam are encoded anew, and their number doubles until the first and the last one come out as they
were. Every neighbouring pair of the whole is then one that BPE leaves as it is, which makes the whole the encoding of its bytes.

Decoding concatenates the bytes of the two halves of the ids, up the same kind of tree.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; equal texts give equal ids;
repeated rows stay repeated; null ids decode like none; columns that are not named in `keep` are left out, so none can clash.
"""
from __future__ import annotations

import base64

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, pick, remembered, whole_text

#: Code points of a leaf; ids of a leaf when decoding.
LEAF = 1024
#: A window of so many code points that is one match is joined token by token.
LONG_MATCH = 4096
#: Before: surely a letter or digit. Behind: surely neither, nor the start of anything that reaches back.
CERTAIN = regex.compile(r"(?<=[A-Za-z0-9À-ÖØ-öø-ɏΑ-ΡΣ-ωА-я一-龥])(?=[ \n!-/:-@\[-`{-~])")
ONE_MATCH = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)")


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size_of = [len(token) for token in self.bytes_of]
        self.matches = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: The same ranks, where any bytes are one match.
        self.whole = tiktoken.Encoding("bytes", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self._stretch(text, 0, len(text))

    def _stretch(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= LEAF:
            return self.matches(text[start:end])
        seam = (start + end) // 2
        return self._join(text, start, seam, end, self._stretch(text, start, seam), self._stretch(text, seam, end))

    def _join(self, text: str, start: int, seam: int, end: int, left: list[int], right: list[int]) -> list[int]:
        reach, i, j = 64, start, end
        while True:
            low, high = max(start, seam - reach), min(end, seam + reach)
            before = [m.start() for m in CERTAIN.finditer(text[low:seam], 1)]
            behind = CERTAIN.search(text[seam:high], 1)
            if (before or low == start) and (behind or high == end):
                i, j = low + before[-1] if before else start, seam + behind.start() if behind else end
                break
            reach *= 4
        kept, dropped = self._cut(left, len(text[i:seam].encode()), -1), self._cut(right, len(text[seam:j].encode()), 1)
        if j - i > LONG_MATCH and ONE_MATCH.fullmatch(text, i, j):
            middle = self._weld(left[kept:], right[:dropped])
        else:
            middle = self.matches(text[i:j])
        del left[kept:]
        left += middle
        left += right[dropped:]
        return left

    def _cut(self, ids: list[int], size: int, step: int) -> int:
        """Where the last (-1) or first (1) `size` bytes of ids begin or end."""
        at = len(ids) if step < 0 else 0
        while size > 0:
            size -= self.size_of[ids[at - 1 if step < 0 else at]]
            at += step
        if size:
            raise AssertionError("a token covers a certain boundary")
        return at

    def _weld(self, left: list[int], right: list[int]) -> list[int]:
        n = 8
        while True:
            a, b = left[-n:], right[:n]
            window = self.whole._encode_single_piece(b"".join(self.bytes_of[t] for t in a + b))
            if (n >= len(left) or window[0] == a[0]) and (n >= len(right) or window[-1] == b[-1]):
                return left[:-n] + window + right[n:]
            n *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join([self.bytes_of[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec(ranks_path: str, pattern: str) -> Codec:
    return remembered(("codec", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens long, ids binary (little-endian unsigned 32-bit integers)."""
    def run(rows):
        found = [codec(ranks_path, pattern).encode(t) for t in rows["_text"]]
        return {c: rows[c] for c in keep} | {"n_tokens": [len(x) for x in found], "ids": [np.array(x, dtype="<u4").tobytes() for x in found]}

    source = pick(df, *keep, text)
    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(source.select(*keep, whole_text(text).alias("_text")), run, kept + "n_tokens long, ids binary")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, decoded binary."""
    def run(rows):
        found = [codec(ranks_path, pattern).decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in rows["_ids"]]
        return {c: rows[c] for c in keep} | {"decoded": found}

    source = pick(df, *keep, ids)
    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(source.select(*keep, F.col(ids).alias("_ids")), run, kept + "decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; the digests are taken by Spark."""
    encoded = encode(df, ranks_path, pattern).withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = decode(encoded, ranks_path, pattern, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
