import random
from difflib import SequenceMatcher
from itertools import combinations

import pytest


from tidymill.operators import similarity as sim


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def words(n, seed, alphabet="abcde", low=1, high=12):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(low, high)))
        out.add(w)
        if rnd.random() < 0.5:
            i = rnd.randrange(len(w) + 1)
            out.add(w[:i] + rnd.choice(alphabet) + w[i + 1:])
    return sorted(out)


def frame(spark, values, name="value"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_near_matches_brute_force(spark):
    vals = words(150, 3) + ["customer#%04d" % i for i in range(0, 60, 7)]
    vals = sorted(set(vals))
    want = {v for v in vals for o in vals if v != o and edits(v, o) <= 2}
    got = {r.value for r in sim.near(frame(spark, vals)).collect()}
    assert got == want


def test_near_between_two_sets(spark):
    left, right = words(60, 5, low=4), words(60, 6, low=4)
    want = {v for v in left for o in right if v != o and edits(v, o) <= 2}
    got = {r.value for r in sim.near(frame(spark, left), frame(spark, right)).collect()}
    # a value present on both sides proves nothing about itself
    assert want <= got and got - want <= set(left) & set(right)


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_ratio_groups_match_brute_force(spark, t):
    vals = words(120, 11, "abcdef", 3, 14) + ["supplier no %03d" % i for i in range(40)]
    vals = sorted(set(vals))
    parent = {v: v for v in vals}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(vals, 2):
        if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= t:
            parent[find(b)] = find(a)
    want = {}
    for v in vals:
        want.setdefault(find(v), set()).add(v)
    got = {}
    for r in sim.similar_groups(frame(spark, vals, "key"), t).collect():
        got.setdefault(r.root, set()).add(r.vertex)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_similar_to_matches_brute_force(spark):
    left, right = words(70, 21, "abcd", 3, 10), words(70, 22, "abcd", 3, 10)
    want = {(a, b) for a in left for b in right if a != b and SequenceMatcher(None, a, b).ratio() >= 0.85}
    got = {(r.a, r.b) for r in sim.similar_to(frame(spark, left, "key"), frame(spark, right, "key"), 0.85).collect()}
    assert got == want


def test_components_on_random_graph_and_long_chain(spark):
    rnd = random.Random(1)
    edges = [(f"v{rnd.randrange(200):03d}", f"v{rnd.randrange(200):03d}") for _ in range(120)]
    edges += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    names = sorted({v for e in edges for v in e} | {"alone"})
    parent = {v: v for v in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.vertex: r.root for r in sim.components(
        frame(spark, names, "vertex"), spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in names}


def test_variant_groups_pick_the_longest_spelling(spark):
    df = frame(spark, ["Paracetamol", "paracetamol ", "Paracetamols", "Ibuprofen", None], "p")
    got = {r.value: r.canonical for r in sim.variant_groups(df, "p", 0.8).collect()}
    assert set(got) == {"Paracetamol", "paracetamol ", "Paracetamols"} and len(set(got.values())) == 1



def test_numbered_values_leave_no_square_of_pairs_to_score(spark, monkeypatch):
    """Names that differ by digits belong together; the exact search is left with what lies between groups. Two families and loose values besides."""
    vals = [f"supplier#{8 * i + 7:09d}" for i in range(500)] + [f"supply-depot {i:04d} north" for i in range(40)] + words(40, 31, "suplier0", 8, 18)
    seen, search = [], sim.candidate_pairs

    def counted(*args, **more):
        pairs = search(*args, **more)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(sim, "candidate_pairs", counted)
    got = {}
    for r in sim.similar_groups(frame(spark, vals, "key"), 0.85).collect():
        got.setdefault(r.root, set()).add(r.vertex)
    parent = {v: v for v in vals}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(vals), 2):
        if find(a) != find(b) and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.85:
            parent[find(b)] = find(a)
    want = {}
    for v in vals:
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert sum(seen) < 10 * len(vals)


def test_pairs_apart_are_those_of_the_whole_search(spark):
    rows = [(v, "big" if i % 4 else f"p{i % 3}") for i, v in enumerate(words(90, 17, "abcd", 4, 12))]
    parts = spark.createDataFrame(rows, "key string, part string")
    pairs = lambda **more: sorted(tuple(r) for r in sim.candidate_pairs(parts, parts, 0.8, **more).collect())
    assert pairs(apart=True) == pairs() != []
