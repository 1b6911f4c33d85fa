"""The candidate search of fuzzy duplicates against brute force: missing components, long and odd texts, low thresholds."""
import random
import re

import pytest

from tidymill.functions.fixed_values import FUZZY_WEIGHTS
from tidymill.operators import duplicates

TEXTS = {"name": ("name_0", "name_1", "name_2"), "id": ("id_0",), "contact": ("contact_0",)}


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _brute_force(texts, threshold):
    heads = {}
    for r in sorted(texts, key=lambda r: r["_rid"]):
        heads.setdefault(tuple(v for k, v in r.items() if k != "_rid"), r)
    rows, found = list(heads.values()), set()
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a["block"] != b["block"]:
                continue
            total = weight = 0
            for k, ts in TEXTS.items():
                sims = [1 - _distance(a[t], b[t]) / max(len(a[t]), len(b[t]), 1) for t in ts if a[t] is not None and b[t] is not None]
                if sims:
                    total, weight = total + FUZZY_WEIGHTS[k] * max(sims), weight + FUZZY_WEIGHTS[k]
            if total / weight >= threshold - 1e-12:
                found.add((a["_rid"], b["_rid"]))
    for r in texts:
        head = heads[tuple(v for k, v in r.items() if k != "_rid")]
        if head is not r:
            found.add((head["_rid"], r["_rid"]))
    return found


def _edited(rnd, text, most):
    for _ in range(rnd.randrange(most + 1)):
        at = rnd.randrange(len(text) + 1)
        text = rnd.choice((text[:at] + rnd.choice("abce19") + text[at:], text[:max(at - 1, 0)] + text[at:], text[:max(at - 1, 0)] + rnd.choice("abce19") + text[at:]))
    return text


def _people(seed, codes):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcde12") for _ in range(n))
    bases = [(f"abc{word(rnd.choice((4, 9, 13)))} {word(7)}", codes(rnd), f"{word(7)}@mail.org") for _ in range(14)] + [("a", "1", "x"), ("ab", "12", "y@z")]
    bases.append(("abc " + " ".join(word(6) for _ in range(24)), codes(rnd), "long@mail.org"))
    rows = []
    for i in range(110):
        name, code, mail = rnd.choice(bases)
        rows.append((i, name[:3] + _edited(rnd, name[3:], 5), None if rnd.random() < 0.2 else _edited(rnd, code, 3), None if rnd.random() < 0.15 else "hot@mail.org" if i % 3 == 0 else _edited(rnd, mail, 4)))
    return rows


@pytest.mark.parametrize("seed,threshold,codes", [
    (1, 0.85, lambda rnd: f"ID{rnd.randrange(1000):05d}"),
    (2, 0.85, lambda rnd: f"{rnd.randrange(10 ** 9):09d}-{rnd.randrange(10 ** 9):09d}"),
    (3, 0.6, lambda rnd: f"ID{rnd.randrange(100000):05d}")])
def test_search_finds_what_brute_force_finds(spark, seed, threshold, codes):
    df = spark.createDataFrame(_people(seed, codes), "_rid int, name string, code string, mail string").repartition(3)
    texts = [r.asDict() for r in duplicates.comparison_texts(df, ["name"], ["code"], ["mail"]).collect()]
    want = _brute_force(texts, threshold)
    got = [(r.rid_a, r.rid_b) for r in duplicates.fuzzy_pairs(df, ["name"], ["code"], ["mail"], threshold=threshold).select("rid_a", "rid_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_windows_hold_a_piece_of_every_near_text():
    rnd = random.Random(5)
    for least in (0.5, 0.6, 0.7375, 0.8125, 0.9):
        for _ in range(400):
            a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 22)))
            b = _edited(rnd, a, 8)
            n, m = len(a), len(b)
            if _distance(a, b) > duplicates._edits(max(n, m), least):
                continue
            edges = duplicates._edges(n, least)
            pieces = {a[x:y] for x, y in zip(edges, edges[1:])}
            assert any(b[at:at + w] in pieces for k, at, w in duplicates._windows(sorted({n, m}), least, True) if k == m), (a, b, least)


def test_pieces_are_not_shuffled_with_their_block(spark, capsys):
    rows = [(i, f"abc{i * 7919 % 10007:05d} stone", f"ID{100000 + i}", f"u{i}@mail.org") for i in range(60)]
    df = spark.createDataFrame(rows, "_rid int, name string, code string, mail string")
    duplicates.fuzzy_pairs(df, ["name"], ["code"], ["mail"]).explain()
    plan = capsys.readouterr().out
    assert "levenshtein" in plan and not re.search(r"hashpartitioning\(block#\d+L?, piece#\d+", plan)
