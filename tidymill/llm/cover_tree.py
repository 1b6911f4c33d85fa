"""Near-duplicate embeddings: all pairs with cosine >= COSINE, by cover trees and dual traversal.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c), so the triangle inequality bounds whole groups. Equal vectors are one point from
the start. The upper levels are a net of at most MOST_PIVOTS points of a bounded sample, taken farthest first (each beginning of
that order covers all at a radius that shrinks down the levels); every point belongs to its nearest pivot. Cells are cut into blocks of about BLOCK
points (fewer of long vectors), one row each, with the covering radius about their pivot: a block is a node. Two blocks meet in one task unless their pivots lie farther apart
than both radii and the threshold. They meet by a Cartesian product, whose tasks read the blocks where the last shuffle left them: a vector is shuffled
three times (by key, into its block, with its block) however many blocks there are. A task holds one block and at most TOGETHER of the other side, or one while there are few.
Of two that meet, points farther from the other's pivot than its radius and the threshold are left out.

In a task each block becomes a cover tree of nested levels with halving radii, and both are traversed together: a pair of nodes farther apart
than both radii and the threshold is pruned, a pair whose farthest points must lie within the threshold is linked as a whole, without looking at its pairs,
and what is left is split or, in leaves, compared by a product of matrices: in single precision with a margin for its rounding, and what that
leaves in double precision. Where points have no
structure (a node that more than SPLIT balls of half its radius are needed for), a node stays a leaf. A task gives each point's number of links and the
edges of a spanning forest, never the pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is a component of its own; of vectors of
different length the shorter counts as continued by zeros; repeated rows are other vectors; a null vec_id takes part and names a component only
if there is no other id; an empty table gives no rows; columns other than vec_id and embedding are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similarity import components
from .frames import map_batches, pick, stored

COSINE = 0.9
BLOCK, MOST_PIVOTS, SAMPLED = 8192, 1024, 4
#: Bytes of a block's vectors; blocks of one side that a task holds at most, once there are more than APART; rows and columns of one product.
BLOCK_BYTES, TOGETHER, APART, TILE = 16 << 20, 8, 16, 512
LEAF, SPLIT = 48, 32
#: Rounding that bounds allow for: the distance of nearly equal points is off by a few times 1e-8.
SLACK = 1e-7


def unit(values: list | None, dim: int) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.zeros(dim)
    x[:len(values)] = values
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x /= top
    return x / math.sqrt(float(x @ x))


def units(points: np.ndarray) -> np.ndarray:
    """Rows that unit() takes, at length one."""
    x = points / np.abs(points).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def farthest_first(points: np.ndarray, most: int) -> list[int]:
    """Indices of at most so many points, each the farthest from those before it."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < most:
        far = np.minimum(far, 2 - 2 * (points @ points[chosen[-1]]))
        nxt = int(far.argmax())
        if far[nxt] <= SLACK:
            break
        chosen.append(nxt)
    return chosen


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class Node:
    __slots__ = ("center", "members", "radius", "children", "joined")

    def __init__(self, center, members, radius):
        self.center, self.members, self.radius, self.children, self.joined = center, members, radius, None, False

    def split(self, points):
        """Children with half the radius, none if the points do not gather so; made when first asked for."""
        if self.children is None:
            self.children = []
            if len(self.members) > LEAF and self.radius > SLACK:
                self._balls(points)
        return self.children

    def _balls(self, points):
        own = points[self.members]
        near, owner, centers, nxt = np.full(len(own), np.inf), np.zeros(len(own), dtype=int), [], self.center
        while True:
            d = distance(own, points[nxt][None, :])[:, 0]
            owner[d < near] = len(centers)
            near = np.minimum(near, d)
            centers.append(nxt)
            at = int(near.argmax())
            if near[at] <= self.radius / 2:
                break
            if len(centers) >= SPLIT:
                return
            nxt = int(self.members[at])
        for k, c in enumerate(centers):
            mine = owner == k
            if mine.any():
                self.children.append(Node(c, self.members[mine], float(near[mine].max())))


class Dual:
    """Counts and a spanning forest of the links between two sets of points (rows of `points`)."""

    def __init__(self, points: np.ndarray, copies: np.ndarray, reach: float, cosine: float):
        self.points, self.copies, self.reach, self.cosine = points, copies, reach, cosine
        self.counts, self.parent, self.edges = np.zeros(len(points), dtype=np.int64), list(range(len(points))), []
        # A product in single precision is off by less than half the margin.
        self.rough, self.least = points.astype(np.float32), cosine - (points.shape[1] + 4) * 2.0 ** -23

    def root_of(self, i):
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def roots(self, members: np.ndarray) -> np.ndarray:
        return np.array([self.root_of(i) for i in members.tolist()])

    def join(self, i, j):
        x, y = self.root_of(i), self.root_of(j)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((i, j))

    def tree(self, members: np.ndarray) -> Node:
        d = distance(self.points[members], self.points[members[0]][None, :])[:, 0]
        return Node(int(members[0]), members, float(d.max()))

    def traverse(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            apart = 0.0 if a is b else float(distance(self.points[[a.center]], self.points[[b.center]])[0, 0])
            if apart > a.radius + b.radius + self.reach + SLACK:
                continue
            if apart + a.radius + b.radius < self.reach - SLACK:
                self.link_all(a, b)
                continue
            wide = a if a.radius >= b.radius else b
            wide = wide if wide.split(self.points) else (b if wide is a else a)
            parts = wide.split(self.points)
            if not parts:
                self.compare(a, b)
            elif a is b:
                todo += [(x, y) for i, x in enumerate(parts) for y in parts[i:]]
            else:
                todo += [(x, b if wide is a else a) for x in parts]

    def link_all(self, a: Node, b: Node) -> None:
        total_a, total_b = int(self.copies[a.members].sum()), int(self.copies[b.members].sum())
        if a is b:
            self.counts[a.members] += total_a - self.copies[a.members]
        else:
            self.counts[a.members] += total_b
            self.counts[b.members] += total_a
        first = int(a.members[0])
        for node in (a, b):
            if not node.joined:
                for m in node.members.tolist():
                    self.join(first, m)
                node.joined = True
        self.join(first, int(b.members[0]))

    def compare(self, a: Node, b: Node) -> None:
        for at in range(0, len(a.members), TILE):
            rows = a.members[at:at + TILE]
            rough = self.rough[rows]
            for to in range(0, len(b.members), TILE):
                others = b.members[to:to + TILE]
                close = rough @ self.rough[others].T >= self.least
                if close.any():
                    self.settle(rows[close.any(axis=1)], others[close.any(axis=0)], a is b)

    def settle(self, rows: np.ndarray, others: np.ndarray, same: bool) -> None:
        """Links between points that may be near; same: rows and others are of one node, whose pairs come in both orders."""
        hits = self.points[rows] @ self.points[others].T >= self.cosine
        if same:
            hits &= rows[:, None] != others[None, :]
        if not hits.any():
            return
        self.counts[rows] += hits @ self.copies[others]
        if not same:
            self.counts[others] += self.copies[rows] @ hits
        while True:
            # Each row joins one of the points it links to that is not yet in its tree; few rounds are left after the first.
            fresh = hits & (self.roots(rows)[:, None] != self.roots(others)[None, :])
            left = np.nonzero(fresh.any(axis=1))[0]
            if not len(left):
                return
            for i, j in zip(rows[left].tolist(), others[fresh[left].argmax(axis=1)].tolist()):
                self.join(i, j)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    given = pick(embeddings, "vec_id", "embedding")
    rows = given.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    reach = math.sqrt(2 - 2 * cosine)
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    # Vectors are shuffled as they were given; that loses nothing.
    kind = np.dtype(np.float32 if given.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64)
    block = max(1, min(block, BLOCK_BYTES // (8 * max(1, dim))))

    def read(part):
        found = [unit(v, dim) for v in part["embedding"]]
        return found, [None if x is None else int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64)) for x in found]

    def given_bytes(values):
        x = np.zeros(dim, dtype=kind)
        x[:len(values)] = values
        return x.tobytes()

    base = stored(map_batches(rows, lambda part: {"vec_id": part["vec_id"], "key": read(part)[1]}, "vec_id long, key long", rows=1024), "units")
    points = base.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    total = points.count()
    wanted = max(1, min(MOST_PIVOTS, -(-total // block)))
    sample = {r["key"] for r in points.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLED * wanted).collect()} if total else set()
    if not sample:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def sampled(part):
        found, keys = read(part)
        taken = {k: x.tobytes() for k, x in zip(keys, found) if k in sample}
        return {"key": list(taken), "vector": list(taken.values())}

    taken = map_batches(rows, sampled, "key long, vector binary", rows=1024).groupBy("key").agg(F.min("vector").alias("vector")).orderBy(F.xxhash64("key"), "key").collect()
    known = np.stack([np.frombuffer(bytes(r["vector"])) for r in taken])
    pivots = known[farthest_first(known, wanted)]
    between = distance(pivots, pivots)

    def nearest(part):
        found, keys = read(part)
        at = [i for i, k in enumerate(keys) if k is not None]
        return at, [keys[i] for i in at], distance(np.stack([found[i] for i in at]), pivots).argmin(axis=1).tolist() if at else []

    def assign(part):
        _, keys, cells = nearest(part)
        return {"key": keys, "cell": cells}

    sizes = np.zeros(len(pivots), dtype=np.int64)
    cells = map_batches(rows, assign, "key long, cell int", rows=1024).groupBy("key").agg(F.min("cell").alias("cell"))
    for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect():    # a row per pivot
        sizes[r["cell"]] = r["n"]
    blocks = np.maximum(1, -(-sizes // block))
    first = np.concatenate([[0], np.cumsum(blocks)])
    n_blocks = int(first[-1])

    def deal(part):
        at, keys, cells = nearest(part)
        own = [int(first[c] + (k % 1_000_003) % blocks[c]) for k, c in zip(keys, cells)]
        return {"key": keys, "block": own, "cell": cells, "vector": [given_bytes(part["embedding"][i]) for i in at]}

    least = F.min(F.struct("block", "cell", "vector"))    # equal vectors are in one block, though their nearest pivots may tie
    dealt = map_batches(rows, deal, "key long, block int, cell int, vector binary", rows=1024).groupBy("key").agg(F.count("*").alias("copies"), least.alias("v")).select("key", "copies", "v.*")

    packing = pa.schema([("block", pa.int32()), ("cell", pa.int32()), ("radius", pa.float64()), ("between", pa.list_(pa.float64())), ("keys", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary())])

    def gather(batches):
        """The block that a partition holds as a row."""
        held = {}
        for batch in batches:
            for name, *row in zip(*(batch[c].to_pylist() for c in ("block", "cell", "key", "copies", "vector"))):
                held.setdefault(name, []).append(row)
        for name, rows in held.items():
            cells, keys, copies, vectors = zip(*rows)
            raw = b"".join(vectors)
            away = distance(units(np.frombuffer(raw, dtype=kind).reshape(-1, dim).astype(float)), pivots[cells[0]][None, :])
            row = [name, cells[0], float(away.max()), between[cells[0]].tolist(), np.array(keys, dtype=np.int64).tobytes(), np.array(copies, dtype=np.int64).tobytes(), raw]
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, packing)], schema=packing)

    packed = dealt.repartitionById(n_blocks, "block").mapInArrow(gather, "block int, cell int, radius double, between array<double>, keys binary, copies binary, vectors binary")
    groups = min(n_blocks, max(APART, -(-n_blocks // TOGETHER)))
    spread = packed.repartitionById(groups, F.col("block") % groups)
    a, b = (spread.select(*(F.col(c).alias(f"{side}_{c}") for c in spread.columns)) for side in "ab")
    even = (F.col("a_block") + F.col("b_block")) % 2 == 0     # each two blocks once, and as often in either order
    once = F.when(even, F.col("a_block") <= F.col("b_block")).otherwise(F.col("a_block") > F.col("b_block"))
    # Both sides take the same columns, else Spark would shuffle them apart.
    near = F.least(F.col("a_between")[F.col("b_cell")], F.col("b_between")[F.col("a_cell")]) <= F.col("a_radius") + F.col("b_radius") + F.lit(reach + SLACK)
    names = ("block", "cell", "radius", "keys", "copies", "vectors")
    met = a.hint("shuffle_replicate_nl").join(b, once & near).select(*(f"{side}_{c}" for side in "ab" for c in names))

    def side(row):
        block, cell, radius, keys, copies, vectors = row
        return block, pivots[cell], radius, np.frombuffer(keys, dtype=np.int64), np.frombuffer(copies, dtype=np.int64), units(np.frombuffer(vectors, dtype=kind).reshape(-1, dim).astype(float))

    def finish(row):
        (one, pivot, radius, keys, copies, x), (other, far, wide, *rest) = side(row[:len(names)]), side(row[len(names):])
        if one == other:
            left = right = np.arange(len(keys))
        else:
            mine, theirs = (distance(p, c[None, :])[:, 0] <= r + reach + SLACK for p, c, r in ((x, far, wide), (rest[2], pivot, radius)))
            keys, copies, x = (np.concatenate([u[mine], v[theirs]]) for u, v in zip((keys, copies, x), rest))
            left, right = np.arange(int(mine.sum())), np.arange(int(mine.sum()), len(keys))
        dual = Dual(x, copies, reach, cosine)
        if len(left) and len(right):
            tree = dual.tree(left)
            dual.traverse(tree, tree if one == other else dual.tree(right))
        linked, (u, v) = np.nonzero(dual.counts)[0], np.array(dual.edges, dtype=np.int64).reshape(-1, 2).T
        counted = np.arange(len(linked) + len(u)) < len(linked)
        return pa.RecordBatch.from_arrays([
            pa.array(keys[np.concatenate([linked, u])]),
            pa.array(keys[np.concatenate([linked, v])], mask=counted),
            pa.array(np.concatenate([dual.counts[linked], np.zeros(len(u), dtype=np.int64)]), mask=~counted),
        ], names=["u", "v", "links"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield finish([c[i].as_py() for c in batch.columns])

    found = stored(met.mapInArrow(run, "u long, v long, links long"), "vector-links")
    edges = found.filter("v is not null").select(F.col("u").alias("a"), F.col("v").alias("b"))
    vertices = edges.select(F.col("a").alias("vertex")).union(edges.select(F.col("b").alias("vertex"))).distinct()
    roots = components(vertices, edges, lambda df: stored(df, "rounds")).withColumnRenamed("vertex", "key")
    links = found.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
    joined = points.join(roots, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = joined.join(named, "root").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = base.select("vec_id", "key").join(by_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
