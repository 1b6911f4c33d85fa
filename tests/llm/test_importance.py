import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidymill.llm import importance

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(corpus, target):
    """(doc_id, n_features, weight, score, rank) of every row, in the order of the draw."""
    s, t = Counter(b for _, text in corpus for b in runs(text)[1]), Counter(b for text in target for b in runs(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    found = []
    for i, text in corpus:
        words, buckets = runs(text)
        weight, h = sum(gain[b] for b in buckets), int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        found.append((len(words) >= 20, i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((f for f in found if f[0]), key=lambda f: (-f[4], f[1] is None, f[1] or 0, f[2]))
    drawn = 5 * len(able) // 100
    return [(*f[1:], k + 1 if k < drawn else None) for k, f in enumerate(able)] + [(*f[1:], None) for f in found if not f[0]]


def check(spark, corpus, target):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in corpus], "doc_id long, text string, bucket int, rank int")
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(corpus, target)))


def texts(rng, n):
    pieces = ["a", "B", "z", "é", "漢", " ", "  ", "\n", "1", ".", "-", "x" * 70, "Y" * 200, "İ", "\x00"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(120))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_buckets_of_runs(block, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", block)
    rows = [*texts(random.Random(3), 200), None, "", " ", "a"]
    got = [[] for _ in rows]
    for text, found in importance.features(rows):
        for ends, buckets in found:
            for place, bucket in zip(text[ends], buckets):
                got[place].append(int(bucket))
    assert [sorted(g) for g in got] == [sorted(runs(r)[1]) for r in rows]


def test_checksums_combine():
    a, b = b"left part", b"q" * 1000
    joined = importance.followed(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
    assert int(joined[0]) == zlib.crc32(a + b)


def test_query_over_given_tables(spark, sf):
    from tidymill.llm.registry import REGISTRY
    corpus = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in REGISTRY["op11_importance_resampling"][0](spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(corpus, target)))
    assert sum(g[4] is not None for g in got) > 5


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    long = " ".join(rng.choice(["so", "many", "words", "ñu"]) for _ in range(30_000))
    twenty = " ".join("w%d" % i for i in range(20))
    corpus = [(1, None), (2, ""), (3, long), (None, twenty), (None, None), (4, twenty), (4, twenty), *[(9, twenty + " hot")] * 60, *((20 + i, t + " " + twenty) for i, t in enumerate(texts(rng, 40)))]
    check(spark, corpus, ["w1 w2 w3", None, "", "many words"])
    monkeypatch.setattr(importance, "BLOCK", 500)
    check(spark, corpus, [])
    check(spark, [(1, None)], ["a b"])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty).count() == 0


@pytest.mark.parametrize("wanted", [None, 0, 1, 777])
def test_ranks_by_regular_sampling(spark, wanted, monkeypatch):
    """Small strides and segments: many splitters, chosen through a second level of samples; a third of the rows alike in all but their number."""
    monkeypatch.setattr(importance, "STRIDE", 4)
    rng = random.Random(wanted)
    rows = [(7 if k % 3 == 0 else rng.randrange(-50, 50) << rng.randrange(40), k) for k in range(3000)]
    rng.shuffle(rows)
    runs_ = importance.sorted_runs(spark.createDataFrame(rows, "value long, row long").repartition(6), ("value", "row"))
    got = {(r.value, r.row): r["rank"] for r in importance.segment_ranks(runs_, ("value", "row"), wanted, segment=60, most_local=50).collect()}
    last = 3000 if wanted is None else wanted
    assert got == {row: (k + 1 if k < last else None) for k, row in enumerate(sorted(rows))}


def test_segments_are_of_even_size(spark, monkeypatch):
    monkeypatch.setattr(importance, "STRIDE", 8)
    rows = spark.createDataFrame([(k * k % 9973, k) for k in range(4000)], "value long, row long").repartition(4)
    runs_ = importance.sorted_runs(rows, ("value", "row"))
    cuts = importance.splitters(runs_, ("value", "row"), 20, 10_000)
    keys = importance._keys(runs_.select("value", "row").toArrow().combine_chunks().to_batches()[0], ("value", "row"))
    sizes = np.bincount(np.searchsorted(cuts, keys, "left"))
    assert len(sizes) in (20, 21) and sizes.max() <= 4000 / 20 + 4 * 8 + 8
