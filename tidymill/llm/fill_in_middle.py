"""Fill-in-middle: a text is cut into prefix, middle and suffix at whole units, and put together in another order with marks between.

A unit is a run of white space and the run of other characters behind it; white space at the end is a unit of its own. A text is parted
into blocks of BLOCK bytes of UTF-8, and a Fenwick tree over the blocks keeps two sums: units that end in a block, and code points that begin in it.
Descending by halving steps finds the block in which the wanted unit ends, with the units and code points before that block; only this
block is then read to locate the end. A unit's end is seen from the byte itself and the next one, so blocks are independent of each other.

A text that holds one of the marks is left plain. Otherwise no mark can arise anywhere else, as no mark begins like another one ends: so parting at
the marks restores the text.

Defined results: a null text counts as empty, which stays plain; a null doc_id hashes as the empty string; repeated rows stay repeated; an empty table
gives no rows; columns not named in `keep` are not read, so none can clash; very long texts need memory for two bits more a byte in slabs.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, pick, whole_text

#: Bytes of a block; bytes that are looked at together while the tree is built.
BLOCK, SLAB = 1024, 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
#: Bytes that begin a code point.
IS_FIRST = np.array([b & 0xC0 != 0x80 for b in range(256)])


class Fenwick:
    """Sums of rows of numbers over prefixes of the blocks."""

    def __init__(self, rows: np.ndarray):
        self.tree = np.vstack([np.zeros((1, rows.shape[1]), dtype=np.int64), rows])
        n, step = len(self.tree), 1
        while step < n:     # every node with this lowest bit hands its sum to its parent
            nodes = np.arange(step, n, 2 * step)
            nodes = nodes[nodes + step < n]
            np.add.at(self.tree, nodes + step, self.tree[nodes])
            step *= 2

    def descend(self, column: int, wanted: int) -> tuple[int, list[int]]:
        """The block in which the running sum of the column reaches `wanted` (at least 1), and the sums before that block."""
        at, before = 0, np.zeros(self.tree.shape[1], dtype=np.int64)
        for step in (1 << k for k in reversed(range(len(self.tree).bit_length()))):
            if at + step < len(self.tree) and before[column] + self.tree[at + step, column] < wanted:
                at += step
                before = before + self.tree[at]
        return at, before.tolist()


def _ends(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether a unit ends at each byte of the stretch."""
    space = IS_SPACE[data[low:high + 1]]
    if high >= len(data):       # the end of the text ends a unit, whichever kind
        return np.append(~space[:-1] & space[1:], True)
    return ~space[:-1] & space[1:]


class Units:
    """Where the units of a text end."""

    def __init__(self, text: str):
        self.bytes = text.encode()
        self.data = np.frombuffer(self.bytes, dtype=np.uint8)
        sums = []
        for low in range(0, len(self.data), SLAB):
            high = min(low + SLAB, len(self.data))
            at = np.arange(0, high - low, BLOCK)
            sums.append(np.stack([np.add.reduceat(_ends(self.data, low, high), at, dtype=np.int64), np.add.reduceat(IS_FIRST[self.data[low:high]], at, dtype=np.int64)], axis=1))
        rows = np.concatenate(sums) if sums else np.zeros((0, 2), dtype=np.int64)
        self.n = int(rows[:, 0].sum())
        self.tree = Fenwick(rows)

    def end_of(self, count: int) -> tuple[int, int]:
        """Bytes and code points of the first `count` units."""
        if count == 0:
            return 0, 0
        block, (units, points) = self.tree.descend(0, count)
        low = block * BLOCK
        ends = np.flatnonzero(_ends(self.data, low, min(low + BLOCK, len(self.data))))
        size = int(ends[count - units - 1]) + 1
        return low + size, points + int(IS_FIRST[self.data[low:low + size]].sum())


def hashes(doc_id: Column, seed: int = 42) -> list[Column]:
    """The first four numbers of 32 bits from the digest of the seeded id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(df: DataFrame, share: int = 50, spm_share: int = 80, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n long, form string, prefix_chars, middle_chars long, output string: of 100 texts about `share` are put in another order, of these `spm_share` suffix first."""
    def one(text, h1, h2, h3, h4):
        units = Units(text)
        if not text or h3 % 100 >= share or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            return units.n, "plain", None, None, text
        first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
        (a, prefix_chars), (b, both_chars) = units.end_of(first), units.end_of(second)
        prefix, middle, suffix = (part.decode() for part in (units.bytes[:a], units.bytes[a:b], units.bytes[b:]))
        if h4 % 100 < spm_share:
            return units.n, "spm", prefix_chars, both_chars - prefix_chars, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
        return units.n, "psm", prefix_chars, both_chars - prefix_chars, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle

    def run(rows):
        found = [one(*r) for r in zip(rows["_text"], *(rows[f"_h{i}"] for i in range(4)), strict=True)]
        return {c: rows[c] for c in keep} | dict(zip(("n", "form", "prefix_chars", "middle_chars", "output"), zip(*found) if found else ((),) * 5, strict=True))

    source = pick(df, *dict.fromkeys((*keep, "doc_id", "text")))
    kept = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    asked = source.select(*keep, whole_text().alias("_text"), *(h.alias(f"_h{i}") for i, h in enumerate(hashes(F.col("doc_id"), seed))))
    return map_batches(asked, run, kept + "n long, form string, prefix_chars long, middle_chars long, output string", rows=64)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, i)
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(formed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    text = restored(F.col("output"), F.col("form"))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))
