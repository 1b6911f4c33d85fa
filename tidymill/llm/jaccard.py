"""Near-duplicate join of documents by the Jaccard similarity of their word shingles, with chosen paths.

A document is the set of its shingles of SHINGLE words (lower case, parted by white space; a shorter text is one shingle). Equal sets are
one class from the start. In each of RUNS runs a set descends from a root: at a node it follows every shingle whose hash, taken
with the node, is below 1 / (SIMILARITY * size). Two sets with at least that similarity share one such shingle a level on average, so they meet
again and again; unlike sets part. Nodes with at most SMALL sets are buckets and compared by brute force; the sets of larger nodes go one level
deeper, up to DEPTH. The number of runs follows from the target recall for a pair right at the threshold.

A bucket is compared in blocks of at most BLOCK sets against each other, so no task holds more than two blocks, however large a group
of copies is. Buckets with the same members are compared once, and a pair that meets in several buckets is counted in the first one. A
comparison of sketches drops pairs far below the threshold, the others are compared exactly. A block gives each set's number of links and
the edges of a spanning forest, never its pairs. Components of these edges are the classes.

Defined results: `class_id` is the least doc_id of the class, `n_links` the number of other documents with at least the similarity, copies
included; null, empty and wordless texts link with nothing, not even with each other; repeated rows are copies; null ids take part, and
are a class's id only if it has no other; an empty table gives no rows; columns other than doc_id and text are not read. Shingles are compared by 40 bits of a hash, sets known by 64.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import components
from .frames import map_batches, pick, remembered, stored, whole_text

SHINGLE, SIMILARITY, RECALL, DEPTH = 5, 0.8, 0.999, 3
SMALL, BLOCK = 200, 800
#: Rows of three numbers that may be broadcast: some 20 MB.
BROADCAST_ROWS = 500_000
REMEMBERED = 150_000
SLICE = 1 << 15
#: Min-hashes of a sketch; pairs that agree in fewer are surely below the threshold (0.8 of 96 less six standard deviations).
SKETCH, AGREE = 96, 53
#: Fixed odd multipliers of the hash mix.
GOLDEN, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def runs_for(depth: int, recall: float = RECALL) -> int:
    """A pair at the threshold shares at least one child of a shared node with 1 - 1/e, and so on down the levels."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = value
        return value


def _hashes() -> WordHashes:
    return remembered("word hashes", WordHashes)


def shingle_set(text: str) -> np.ndarray:
    """Sorted different 40-bit hashes of the shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_hashes().__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - SHINGLE + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(w))):
        total = mixed(total * GOLDEN + w[k:k + n])
    return np.unique(total >> np.uint64(24))


def key_of(tokens: np.ndarray) -> int | None:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))) if len(tokens) else None


def packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def paths(tokens: np.ndarray, runs: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level (parents, nodes) of the set; a level's parents are nodes of the level above, the first level's are the runs."""
    share = min(1.0, 1 / (SIMILARITY * len(tokens)))
    bound = np.uint64(min(2 ** 64 - 1, int(share * 2.0 ** 64)))
    names, seeds, out = np.arange(runs, dtype=np.uint64), mixed(np.arange(1, runs + 1, dtype=np.uint64) * GOLDEN), []
    for _ in range(depth):
        parents, children = [], []
        for at in range(0, len(tokens), SLICE):     # of a very long set a slice at a time
            grid = mixed(tokens[None, at:at + SLICE] * MIX_B + seeds[:, None])
            row, column = np.nonzero(grid <= bound)
            parents.append(names[row])
            children.append(mixed(grid[row, column] ^ seeds[row] * GOLDEN))
        out.append((np.concatenate(parents), np.concatenate(children)))
        names = seeds = np.unique(out[-1][1])
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.astype(np.int64).tolist()


def described(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, mark, key, l1, l2, ...: the levels as arrays of (parent, node); key is null for a text without words."""
    runs = runs_for(depth)
    level = "array<struct<parent:bigint,node:bigint>>"

    def run(rows):
        out = {"doc_id": rows["doc_id"], "mark": rows["mark"], "key": []} | {f"l{k}": [] for k in range(1, depth + 1)}
        for text in rows["text"]:
            tokens = shingle_set(text)
            out["key"].append(key_of(tokens))
            found = paths(tokens, runs, depth) if len(tokens) else [(np.zeros(0, np.uint64),) * 2] * depth
            for k, (parents, nodes) in enumerate(found, 1):
                out[f"l{k}"].append([{"parent": p, "node": n} for p, n in zip(_signed(parents), _signed(nodes))])
        return out

    return map_batches(docs, run, "doc_id long, mark long, key long, " + ", ".join(f"l{k} {level}" for k in range(1, depth + 1)), rows=128)


def buckets_of(base: DataFrame, depth: int, small: int) -> DataFrame:
    """bucket, key: at least two sets in each, no two buckets with the same members."""
    found, parents = [], None
    for k in range(1, depth + 1):
        level = base.filter("key is not null").select("key", F.explode(f"l{k}").alias("x")).select("key", "x.parent", "x.node")
        if parents is not None:
            level = stored(level.join(parents, "parent", "left_semi"), f"level{k}")     # read by counts, members and the next level
        sizes = level.select("node", "key").distinct().groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        final = sizes if k == depth else sizes.filter(F.col("size") <= small)
        # Small nodes of the first levels need fewer runs than the deepest ones for the same recall.
        members = level if k > 1 else level.filter(F.col("parent") < runs_for(1))
        found.append(members.join(final, "node").select(F.col("node").alias("bucket"), "key").distinct())
        parents = sizes.filter(F.col("size") > small).select(F.col("node").alias("parent"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = stored(every, "memberships")
    marks = every.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("a"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("b"))
    kept = marks.filter("size > 1").groupBy("size", "a", "b").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return every.join(kept, "bucket")


def _links(keys, sets, copies, held, bucket, side):
    """Links within one comparison. side: None compares all pairs, else only those of a 0 with a 1."""
    n = len(keys)
    seen = np.zeros((n, n), dtype=bool)
    places: dict[int, list[int]] = {}
    for i, own in enumerate(held):
        for b in own:
            if b < bucket:
                places.setdefault(b, []).append(i)
    for at in places.values():
        if len(at) > 1:
            seen[np.ix_(at, at)] = True
    seeds = mixed(np.arange(7, 7 + SKETCH, dtype=np.uint64) * GOLDEN)
    sketch = np.stack([(mixed(s[None, :] * MIX_A + seeds[:, None]).min(axis=1) >> np.uint64(40)).astype(np.uint32) for s in sets])
    sizes = np.array([len(s) for s in sets])
    counts, parent, edges = [0] * n, list(range(n)), []

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n - 1):
        near = (~seen[i, i + 1:]) & (sizes[i + 1:] >= SIMILARITY * sizes[i] - 1e-9) & (sizes[i + 1:] * SIMILARITY <= sizes[i] + 1e-9)
        if side is not None:
            near &= side[i + 1:] != side[i]
        others = np.nonzero(near)[0] + i + 1
        if not len(others):
            continue
        others = others[(sketch[others] == sketch[i]).sum(axis=1) >= AGREE]
        for j in others.tolist():
            a, b = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            if common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9:
                counts[i] += copies[j]
                counts[j] += copies[i]
                x, y = root(i), root(j)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    edges.append((keys[i], keys[j]))
    return counts, edges


def compared(memberships: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """u, v, links: an edge of a forest (links null), or with v null so many links of u."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = memberships.groupBy("key").agg(F.sort_array(F.collect_list("bucket")).alias("held"))
    rows = (memberships.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int"))
            .join(own, "key").join(sets, "key"))
    # A block meets itself and every other one; the pair of blocks is a comparison.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumn("other", other).select("bucket", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "key", "copies", "held", "tokens")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(4 * parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "key")

    def finish(name, rows):
        bucket, a, b = name
        unique = {r[1]: r for r in rows}
        keys = list(unique)
        if len(keys) < 2:
            return []
        side = None if a == b else np.array([int(unique[k][0] == b) for k in keys])
        counts, edges = _links(keys, [unpacked(unique[k][4]) for k in keys], [unique[k][2] for k in keys], [unique[k][3] for k in keys], bucket, side)
        return [(k, None, c) for k, c in zip(keys, counts) if c] + [(u, v, None) for u, v in edges]

    def run(batches):
        name, rows = None, []
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for bucket, a, b, *row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    if (bucket, a, b) != name:
                        out += finish(name, rows) if rows else []
                        name, rows = (bucket, a, b), []
                    rows.append(row)
            yield _batch(out)
        yield _batch(finish(name, rows) if rows else [])

    return dealt.mapInArrow(run, "u long, v long, links long")


def _batch(rows):
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "links"])


def near_duplicates(documents: DataFrame, depth: int = DEPTH, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links of every document, mark (a hash of its text) and kept: whether it is the first of its class by doc_id, then mark."""
    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    base = stored(described(docs.withColumn("mark", F.xxhash64("text")), depth), "paths")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    classes = base.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(place).alias("first"), F.count("*").alias("copies"))
    memberships = stored(buckets_of(base, depth, small), "buckets")

    def with_tokens(rows):
        found = [shingle_set(t) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "key": [key_of(x) for x in found], "tokens": [packed(x) for x in found]}

    # Only sets that meet another one are shuffled: where they are few, they are broadcast to the scan, else joined by key.
    needed = stored(classes.select("key", "least", "copies").join(memberships.select("key").distinct(), "key", "left_semi"), "needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    sets = map_batches(docs, with_tokens, "doc_id long, key long, tokens binary", rows=256).alias("s").join(
        needed.alias("n"), (F.col("s.key") == F.col("n.key")) & F.col("s.doc_id").eqNullSafe(F.col("n.least"))).select("s.key", "copies", "tokens").dropDuplicates(["key"])
    found = stored(compared(memberships, sets, block), "links")
    edges = found.filter("v is not null").select("u", "v")
    vertices = edges.select(F.col("u").alias("vertex")).union(edges.select(F.col("v").alias("vertex"))).distinct()
    roots = components(vertices, edges.select(F.col("u").alias("a"), F.col("v").alias("b")), lambda df: stored(df, "rounds"))
    links = found.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    placed = (classes.join(roots.withColumnRenamed("vertex", "key"), "key", "left").join(links, "key", "left")
              .select("key", "least", "first", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    named = placed.groupBy("root").agg(F.min("least").alias("class_id"), F.min("first").alias("class_first"))
    by_key = placed.join(named, "root").select("key", "class_id", "class_first", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = F.col("key").isNull()
    return (base.select("doc_id", "mark", "key").join(by_key, "key", "left")
            .select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    "mark", (alone | place.eqNullSafe(F.col("class_first"))).alias("kept")))
