import random
from collections import Counter

import numpy as np

from tidymill.llm import jaccard
from tidymill.llm.registry import REGISTRY


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """Counter of (doc_id, class_id, n_links)."""
    sets = [shingles(t) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, c in common.items():
            if c / (len(s) + len(sets[j]) - c) >= 0.8:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((doc, least.get(find(i)) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows))


def planted(n=300, seed=2):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    passage = " ".join(rng.choices(words, k=50))
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice((8, 40, 120)))
        for _ in range(n // 12):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += [" ".join(rng.choices(words, k=rng.randrange(5, 60))) + " " + passage for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, key int")
    return Counter(tuple(r)[:3] for r in jaccard.near_duplicates(df, **options).collect())


def test_pieces():
    tokens = jaccard.shingle_set("a b c d e f g a b c d e f g")
    assert len(tokens) == len(shingles("a b c d e f g a b c d e f g"))
    assert (jaccard.unpacked(jaccard.packed(tokens)) == tokens).all() and len(jaccard.unpacked(b"")) == 0
    assert [jaccard.runs_for(k) for k in (1, 2, 3)] == [7, 11, 15]
    tokens = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 200, dtype=np.uint64))
    assert 400 < sum(len(jaccard.paths(tokens, 400, 3)[0][1]) for _ in range(1)) < 600


def test_planted_groups_against_brute_force(spark):
    rows = planted()
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, small=4, block=7) == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "alone here"), (8, "long " * 40000), (9, "x" * 200000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, "")]) == Counter({(1, 1, 0): 1})
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r)[:3] for r in REGISTRY["op9_ngram_jaccard_join"][0](spark, sf).collect()) == brute(rows)
