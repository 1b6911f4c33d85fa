from collections import Counter

import numpy as np

from tidymill.llm import cover_tree
from tidymill.llm.registry import REGISTRY


def brute(rows):
    units = [cover_tree.unit(v, 8 if not any(v and len(v) > 8 for _, v in rows) else max(len(v or ()) for _, v in rows)) for _, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(units):
        for j in range(i):
            if x is not None and units[j] is not None and float(x @ units[j]) >= 0.9:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[find(i)] = min(v, least.get(find(i), v))
    return Counter((v, n[i], least.get(find(i)) if units[i] is not None else v) for i, (v, _) in enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, key int, cell string")
    got = cover_tree.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return Counter(tuple(r)[:3] for r in got)


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for size, noise in ((150, 0.001), (80, 0.1), (60, 0.2), (200, 3.0)):
        center = rng.standard_normal(8)
        for _ in range(size):
            rows.append((i, (center + noise * rng.standard_normal(8)).tolist()))
            i += 1
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=40) == want


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [None, 1.0]), (5, [float("nan")] * 8), (6, [float("inf"), 1.0]), (7, one), (8, one), (8, one), (9, [2.0, 4.0, 6.0]), (None, one), (10, [1e300, 2e300, 3e300]), (11, [-x for x in one])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:6]) == brute(rows[:6])
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_whole_groups_are_linked_without_comparing(monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(64) + 0.001 * rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(cover_tree.Dual, "compare", lambda *a: 1 / 0)
    dual = cover_tree.Dual(x, np.ones(2000, dtype=np.int64), 0.2 ** 0.5, 0.9)
    root = dual.tree(np.arange(2000))
    dual.traverse(root, root)
    assert (dual.counts == 1999).all() and len(dual.edges) == 1999


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter(tuple(r)[:3] for r in REGISTRY["op4_embedding_near_dedup"][0](spark, sf).collect()) == brute(rows)


def shuffled(spark):
    """Bytes that the session has written to shuffles so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_shuffles_do_not_grow_with_the_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "APART", 3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16))
    x[200:260] = x[5] + 0.2 * rng.standard_normal((60, 16))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    want, written = brute(rows), []
    for block in (1500, 50):
        before = shuffled(spark)
        assert run(spark, rows, block=block) == want
        written.append(shuffled(spark) - before)
    assert 0 < written[1] < 2 * written[0]


def test_double_precision_decides_at_the_threshold():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    angles = 0.9 + np.concatenate([[1e-9, 1e-12], -np.array([1e-9, 1e-12])])
    x = np.stack([q[0], *(c * q[0] + np.sqrt(1 - c * c) * q[k + 1] for k, c in enumerate(angles))])
    dual = cover_tree.Dual(x, np.ones(5, dtype=np.int64), 0.2 ** 0.5, 0.9)
    root = dual.tree(np.arange(5))
    dual.traverse(root, root)
    assert dual.counts.tolist() == [2, 1, 1, 0, 0] and sorted(map(sorted, dual.edges)) == [[0, 1], [0, 2]]
