"""Importance resampling towards a target: documents whose word runs are commoner in the target than in the corpus get larger weights,
and a draw without replacement takes a share of them by weight and Gumbel noise.

Features are all runs of 1 to 3 words, hashed by crc32 into a fixed number of buckets. They are scored as arrays: the crc32 of all words of
about a megabyte of text at once, those of longer runs by combining the checksums of their words (crc32 is linear over bits), never by
building the strings. Counting sends one row per bucket and task, so what is shuffled depends on tasks and buckets, not on words.

Ranks come from parallel sorting by regular sampling. Every task sorts its rows into a run and marks every STRIDE-th row of it. The marked rows
give regular splitters; rows are exchanged by the segment between two splitters in which they fall, and each segment merges the pieces of the
runs locally. Counts of the segments before give the exact rank. Segments wholly behind the last rank wanted are not exchanged at all. The sort
key ends in a number of the row, so rows alike in everything are split as well. If there are more marked rows than MOST_LOCAL, splitters are
chosen by ranking the marked rows in the same way: what reaches the driver is bounded at every level, but for one key per SEGMENT rows.

Defined results: a null text has no words, hence weight 0; an empty table gives no rows; repeated rows are rows of their own, with ranks of their
own; ties of score go to the smaller doc_id (null last), then to fewer features; columns other than doc_id and text are not read; very long
texts are read block by block, each with the last two words of the one before.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, stored, whole_text

BUCKETS, LONGEST_RUN = 10_000, 3
#: Bytes of text whose arrays are held at once.
BLOCK = 1 << 20
#: Words longer than this have their checksum taken one by one; runs are combined in steps of it.
SHORT = 64
#: Of a sorted run every so many rows is a sample; rows of a segment; samples that the driver sorts by itself.
STRIDE, SEGMENT, MOST_LOCAL = 64, 1_000_000, 200_000

#: Word characters behind ASCII lower-casing: digits, a to z, all of other scripts.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _byte_table() -> np.ndarray:
    """crc32's register after one byte of each value."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


ONE = _byte_table()


def _zero_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, of value b, becomes when n zero bytes follow."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    found = [now]
    for _ in range(SHORT):
        now = ONE[now & 255] ^ (now >> 8)
        found.append(now)
    return np.array(found, dtype=np.uint32)


ZEROS = _zero_tables()


def followed(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The part of crc32(a + b) that comes from crc32(a), where b has so many bytes; xor crc32(b) for the whole."""
    crc, size = crc.copy(), size.astype(np.int64)
    while True:
        n = np.minimum(size, SHORT)
        crc = ZEROS[n, 0, crc & 255] ^ ZEROS[n, 1, (crc >> 8) & 255] ^ ZEROS[n, 2, (crc >> 16) & 255] ^ ZEROS[n, 3, crc >> 24]
        size = size - n
        left = np.flatnonzero(size)
        if not len(left):
            return crc
        crc[left] = followed(crc[left], size[left])
        return crc


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of the stretches of data, all at a time byte by byte."""
    order = np.argsort(-np.minimum(sizes, SHORT + 1), kind="stable")
    at, size = starts[order], sizes[order]
    c = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(SHORT, int(size[0]) if len(size) else 0)):
        n = int(np.searchsorted(-size, -k, "left"))
        c[:n] = ONE[(c[:n] ^ data[at[:n] + k]) & 255] ^ (c[:n] >> 8)
    found = np.empty_like(c)
    found[order] = ~c
    for i in np.flatnonzero(sizes > SHORT):
        found[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes())
    return found


def _blocks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Numbers of texts, their bytes, and how many leading words of each are only there for the runs that begin with them."""
    numbers, parts, skips, held = [], [], [], 0
    for i, text in enumerate(texts):
        at, skip, lead = 0, 0, b""
        while True:
            end = at + BLOCK
            while end < len(text) and IN_WORD[text[end]]:
                end += 1
            part = lead + text[at:end]
            numbers.append(i)
            parts.append(part)
            skips.append(skip)
            held += len(part)
            if held >= BLOCK:
                yield numbers, parts, skips
                numbers, parts, skips, held = [], [], [], 0
            if end >= len(text):
                break
            tail, found = end, []
            while tail > 0 and len(found) < LONGEST_RUN - 1:
                while tail > 0 and not IN_WORD[text[tail - 1]]:
                    tail -= 1
                start = tail
                while start > 0 and IN_WORD[text[start - 1]]:
                    start -= 1
                if tail > start:
                    found.append(text[start:tail])
                tail = start
            at, skip, lead = end, len(found), b"".join(word + b"\x00" for word in reversed(found))
    if numbers:
        yield numbers, parts, skips


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For blocks of words: the number of each word's text, and for runs of 1, 2, 3 words the places of their last words with the runs' buckets."""
    for numbers, parts, skips in _blocks([(t or "").encode().lower() for t in texts]):
        data = np.frombuffer(b"\x00".join(parts) + b"\x00", dtype=np.uint8)
        edges = np.flatnonzero(np.diff(IN_WORD[data].astype(np.int8), prepend=0))
        starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
        part = np.searchsorted(np.cumsum([0, *(len(p) + 1 for p in parts)]), starts, "right") - 1
        first = np.searchsorted(part, np.arange(len(parts)))
        place = np.arange(len(starts)) - first[part]
        counted = place >= np.array(skips)[part]
        crc, runs = checksums(data, starts, sizes), []
        spaced = followed(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), sizes) ^ crc
        now = crc
        for n in range(1, LONGEST_RUN + 1):
            if n > 1:
                now = np.concatenate([now[:1], followed(now[:-1], sizes[1:] + 1) ^ spaced[1:]])
            ends = np.flatnonzero(counted & (place >= n - 1))
            runs.append((ends, now[ends] % BUCKETS))
        yield np.array(numbers)[part], runs


def bucket_counts(df: DataFrame, side: str) -> DataFrame:
    """side string, bucket int, n long: one row per task and bucket that occurs."""
    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for _, runs in features(batch.column(0).slice(at, 256).to_pylist()):
                    for _, buckets in runs:
                        total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([side] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(total[found])], names=["side", "bucket", "n"])

    return pick(df, "text").select(F.col("text").cast("string")).mapInArrow(run, "side string, bucket int, n long")


def gains(corpus: DataFrame, target: DataFrame) -> np.ndarray:
    """A bucket's gain, from one row per bucket: BUCKETS numbers whatever the tables hold."""
    counted = bucket_counts(corpus, "corpus").unionByName(bucket_counts(target, "target"))
    rows = counted.groupBy("bucket").agg(*(F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(side) for side in ("corpus", "target"))).collect()
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in rows:
        s[row["bucket"]], t[row["bucket"]] = row["corpus"], row["target"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weigh(df: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256).to_pylist()
                words, found, weight = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
                for text, runs in features(texts):
                    words += np.bincount(text[runs[0][0]], minlength=len(texts))
                    for ends, buckets in runs:
                        found += np.bincount(text[ends], minlength=len(texts))
                        # Sums of whole numbers below 2^53 are exact in doubles.
                        weight += np.bincount(text[ends], weights=gain[buckets], minlength=len(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(found), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    docs = pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _keys(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    """Rows of longs as byte strings of the same order."""
    longs = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
    return np.ascontiguousarray((longs.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def sorted_runs(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows, sorted within each task, with `sample` for every STRIDE-th of a run: written once, as one file a run."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        seen = 0
        for batch in batches:
            place = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place % STRIDE == STRIDE // 2)], names=[*batch.schema.names, "sample"])

    return stored(rows.sortWithinPartitions(*columns).mapInArrow(run, schema + ", sample boolean"), "runs")


def splitters(runs: DataFrame, columns: tuple[str, ...], segments: int, most_local: int) -> np.ndarray:
    """Sorted keys that part the rows into so many segments of about the same size."""
    samples = runs.filter("sample").select(*columns)
    n = samples.count()
    if segments < 2 or not n:
        return np.array([], dtype=f"S{8 * len(columns)}")
    step = max(1, -(-n // segments))
    if n <= most_local:
        chosen = pa.Table.from_batches(samples.toArrow().to_batches(), samples.toArrow().schema).combine_chunks()
        keys = np.sort(_keys(chosen.to_batches()[0], columns))
        return keys[step - 1::step]
    ranked = segment_ranks(sorted_runs(samples, columns), columns, None, most_local=most_local)
    chosen = ranked.filter(F.col("rank") % step == 0).select(*columns).toArrow().combine_chunks()
    return np.sort(_keys(chosen.to_batches()[0], columns)) if chosen.num_rows else np.array([], dtype=f"S{8 * len(columns)}")


def segment_ranks(runs: DataFrame, columns: tuple[str, ...], wanted: int | None, segment: int = SEGMENT, most_local: int = MOST_LOCAL) -> DataFrame:
    """All rows with `rank` long: 1, 2, 3 ... in ascending order of the columns (longs that are not null and together unique), null behind `wanted`."""
    total = runs.count()
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = splitters(runs, columns, max(-(-total // segment), min(parts, -(-total // max(1, segment // 100)))), most_local)
    rows = runs.drop("sample")

    def placed(before: np.ndarray | None):
        def run(batches):
            for batch in batches:
                number = np.searchsorted(cuts, _keys(batch, columns), "left")
                if before is None:
                    found = np.bincount(number, minlength=1)
                    at = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["segment", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(before[number])], names=[*batch.schema.names, "segment", "before"])
        return run

    counted = rows.select(*columns).mapInArrow(placed(None), "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(len(cuts) + 1, dtype=np.int64)
    for row in counted:
        sizes[row["segment"]] = row["n"]
    before = np.cumsum(sizes) - sizes
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", segment long, before long"
    dealt = rows.mapInArrow(placed(before), schema)
    last = total if wanted is None else wanted
    merged = dealt.filter(F.col("before") < last).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("segment").orderBy(*columns)))
    behind = dealt.filter(F.col("before") >= last).withColumn("rank", F.lit(None).cast("long"))
    return merged.withColumn("rank", F.when(F.col("rank") <= last, F.col("rank"))).unionByName(behind).drop("segment", "before")


def resample(corpus: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ranked are floor(share * N) of the N documents with enough words."""
    weighed = weigh(corpus, gains(corpus, target))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((hashed + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = (weighed.withColumn("score", F.col("weight") + noise).withColumn("first", F.when(F.col("n_words") >= least_words, 0).otherwise(1).cast("long"))
              .withColumn("falling", -F.col("score")).withColumn("id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("row", F.monotonically_increasing_id()))
    columns = ("first", "falling", "id", "n_features", "row")
    runs = sorted_runs(scored, columns)
    able = runs.filter("first = 0").count()
    ranked = segment_ranks(runs, columns, able * share[0] // share[1])
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")
