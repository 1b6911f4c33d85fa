import hashlib
import random
import re

import numpy as np
import pytest

from tidymill.llm import fill_in_middle as fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts(n=200):
    rng = random.Random(4)
    pieces = ["a", "bc", "é", "漢", "🙂", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "<", "P>", "x" * 30]
    yield from ("", " ", "a", " a", "a ", "\n\n")
    for _ in range(n):
        yield "".join(rng.choice(pieces) for _ in range(rng.randrange(80)))


@pytest.mark.parametrize("block, slab", [(1024, 1 << 20), (4, 16), (1, 1), (8, 8)])
def test_ends_of_units(block, slab, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", block)
    monkeypatch.setattr(fim, "SLAB", slab)
    for text in texts():
        units, found = UNITS.findall(text), fim.Units(text)
        assert found.n == len(units)
        for k in range(len(units) + 1):
            start = "".join(units[:k])
            assert found.end_of(k) == (len(start.encode()), len(start))


def test_tree_against_running_sums():
    rows = np.random.default_rng(1).integers(0, 3, (77, 2))
    tree, sums = fim.Fenwick(rows), np.vstack([[0, 0], np.cumsum(rows, axis=0)])
    for wanted in range(1, int(sums[-1, 0]) + 1):
        block, before = tree.descend(0, wanted)
        assert block == int(np.searchsorted(sums[1:, 0], wanted)) and before == sums[block].tolist()


def plain(i, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNITS.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, len(units), "plain", None, None, sha(text), sha(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return i, len(units), form, len(p), len(m), sha(out), sha(text)


def test_query(spark, sf):
    from tidymill.llm.registry import REGISTRY
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = REGISTRY["op12_fill_in_middle"][0](spark, sf).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 16)
    rows = [(1, None), (2, ""), (None, None), (None, "no id at all"), (3, "x" * 300_000), (3, "x" * 300_000), (4, "word\n " * 60_000), (5, "holds <S> a mark"), *enumerate(texts(150), 10)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n int, form string")
    got = fim.digests(fim.transform(df)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(plain(i, t)) for i, t in rows)
    assert fim.transform(df.limit(0)).count() == 0


def test_marks_that_nearly_arise(spark):
    """Parts that end and begin like marks are restored."""
    rows = [(i, t) for i in range(120) for t in ("a< P> S>", "x <P <S <M y", "<<P <<S M> >")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    formed = fim.transform(df, share=100, keep=("doc_id", "text"))
    bad = formed.filter(fim.restored(formed["output"], formed["form"]) != formed["text"])
    assert bad.count() == 0 and formed.filter("form <> 'plain'").count() == len(rows)
