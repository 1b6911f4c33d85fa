import random

import pytest

from tidymill.plans import ordered
from tidymill.plans.quantiles import exact_quantiles, exact_quantiles_of
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    # a third of the rows share one order key
    data = [(i, 50 if i % 3 == 0 else rnd.randrange(100), rnd.choice([None, 1, 2, 3, 4]), rnd.choice("aab")) for i in range(400)]
    return sorted(data, key=lambda r: (r[1], r[0])), spark.createDataFrame(data, "id int, k int, v int, g string").repartition(7)


@pytest.mark.parametrize("ranges", [1, 6, 23])
def test_running_total(rows, ranges):
    data, df = rows
    total, want = 0, {}
    for i, _, v, _ in data:
        total += v or 0
        want[i] = total
    assert {r.id: r.t for r in ordered.running_total(df, ["k", "id"], "v", "t", ranges).collect()} == want


@pytest.mark.parametrize("ranges", [1, 6])
def test_neighbours_and_fill(rows, ranges):
    data, df = rows
    want, last = {}, None
    for i, _, v, _ in data:
        want[i] = [last, None, v if v is not None else last]
        last = v if v is not None else last
    nxt = None
    for i, _, v, _ in reversed(data):
        want[i][1] = nxt
        nxt = v if v is not None else nxt
    got = {r.id: [r.v_prev, r.v_next] for r in ordered.neighbours(df, ["k", "id"], ["v"], ranges).collect()}
    assert got == {i: w[:2] for i, w in want.items()}
    filled = {r.id: r.v for r in ordered.forward_fill(df, ["k", "id"], ["v"], ranges).collect()}
    assert filled == {i: w[2] for i, w in want.items()}


def test_moving_average_across_blocks(rows):
    data, df = rows
    df = df.withColumn("x", F.coalesce("v", F.lit(0)).cast("double"))
    xs = [v or 0 for _, _, v, _ in data]
    want = {r[0]: (sum(xs[p - 4:p + 1]) / 5 if p >= 4 else None) for p, r in enumerate(data)}
    got = {r.id: r.m for r in ordered.moving_average(df, ["k", "id"], "x", 5, "m", block=16, ranges=5).collect()}
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {k: v if v is None else round(v, 9) for k, v in want.items()}


def test_rank_within_a_group_spread_over_ranges(rows):
    data, df = rows
    want = {i: None if v is None else 1 + sum(1 for _, _, w, h in data if h == g and w is not None and w > v) for i, _, v, g in data}
    assert {r.id: r.rank for r in ordered.rank_within(df, "g", "v", ranges=4).collect()} == want


def test_gaps(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 5, 9, 10, None)], "k int")
    assert sorted(map(tuple, ordered.integer_gaps(df, "k").collect())) == [(3, 4), (6, 8)]
    assert sorted(map(tuple, ordered.integer_gaps(df.filter("k > 2"), "k", start=1, ranges=2).collect())) == [(1, 4), (6, 8)]


def _plain_quantiles(xs, probs):
    ys, want = sorted(xs), []
    for p in probs:
        h = (len(ys) - 1) * p
        k = int(h)
        want.append(ys[k] if ys[k] == ys[min(k + 1, len(ys) - 1)] else ys[k] + (ys[min(k + 1, len(ys) - 1)] - ys[k]) * (h - k))
    return want


def test_quantiles_by_radix_selection(spark):
    """All columns at once: a frequent value, negative and tiny numbers, infinities, both zeros, gaps, and a column without values."""
    rnd = random.Random(9)
    columns = {"a": lambda: rnd.choice([7.0, rnd.random() * 100]), "b": lambda: rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-320, 300), "c": lambda: rnd.choice([0.0, -0.0, float("inf"), float("-inf"), 1.5]),
               "d": lambda: rnd.choice([None, float("nan"), float(rnd.randint(-9, 9))]), "e": lambda: None, "f": lambda: 4.0}
    rows = [tuple(make() for make in columns.values()) for _ in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles_of(df, {c: F.col(c) for c in columns}, probs)
    for i, c in enumerate(columns):
        xs = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[c] == (_plain_quantiles(xs, probs) if xs else [None] * len(probs)), c
    assert exact_quantiles(df.limit(0), F.col("a"), [0.5]) == [None]
    assert exact_quantiles_of(df, {"a": F.col("a"), "d": F.col("d")}, {"a": [0.5], "d": []})["d"] == []


def test_thousands_of_ranges(spark, monkeypatch):
    """More ranges than stand in a plan, cut points from a sample that the driver does not order, nodes of a few ranges."""
    monkeypatch.setattr(ordered, "DRIVER_KEYS", 1000)
    monkeypatch.setattr(ordered, "BRANCH", 64)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, "a", "b", "c" + str(i % 50)]), rnd.choice([None, rnd.randint(-5, 9)])) for i in range(12_000)]
    df = spark.createDataFrame(rows, "_rid long, word string, v int").repartition(4)
    cuts = ordered.cut_points(df, ["word", "_rid"], 5000)
    assert len(cuts) > 3000
    sizes = ordered.with_ranges(df, ["word", "_rid"], 5000).groupBy("_range").count()
    assert sizes.count() == len(cuts) + 1 and sizes.agg(F.max("count")).first()[0] < 60
    want, total, seen, last = {}, 0, 0, None
    for i, word, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0])):
        total, seen = total + (v or 0), seen + 1
        want[i] = (total, seen, last)
        last = v if v is not None else last
    got = ordered.running_totals(df.withColumn("one", F.lit(1)), ["word", "_rid"], {"t": "v", "n": "one"}, 5000).collect()
    assert {r._rid: (r.t, r.n) for r in got} == {i: w[:2] for i, w in want.items()}
    paired = ordered.neighbours(df, ["word", "_rid"], ["v"], 5000).collect()
    assert {r._rid: r.v_prev for r in paired} == {i: w[2] for i, w in want.items()}
    following, nxt = None, {}
    for i, word, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]), reverse=True):
        nxt[i] = following
        following = v if v is not None else following
    assert {r._rid: r.v_next for r in paired} == nxt
