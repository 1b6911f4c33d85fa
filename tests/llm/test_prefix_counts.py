import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidymill.llm import prefix_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def table():
    return prefix_counts.prefixes(PATH)


def texts(n=400):
    rng = random.Random(5)
    pieces = ["the", " of", "  ", "\n", "'s", "'re", "'v", "'", "'ll", "'l", "e", "x" * 5, "é", "漢字", "12", "3", "!!", "...", " ", "\x1c", "՘", "\x85", "<|endoftext|>", "<|endof", "🙂",
              " international", "ation", "aaaa", "\t", "₏", "A", "'RE", "　"]
    for _ in range(n):
        yield "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))


def test_every_prefix(table, library):
    for text in texts():
        assert table.counts(text).tolist() == [library(text[:i]) for i in range(len(text) + 1)], text


@pytest.mark.parametrize("alphabet", ["ab", "etaoinshr", "0123456789", "!?-=#", " \n\t", "a", "漢字é", " a"])
def test_long_matches(table, library, alphabet):
    rng = random.Random(1)
    text = "".join(rng.choice(alphabet) for _ in range(3000))
    counts = table.counts(text)
    assert all(counts[i] == library(text[:i]) for i in range(0, 3001, 41))


def test_batches_share_states(table, library):
    rows = [*texts(100), "", "thing things thinking", "x" * 5000]
    assert [c.tolist()[-1] for c in table.counts_of(rows)] == [library(t) for t in rows]


def test_code_points_that_are_split_here(table):
    """Those that are not handed to the library have the class that it gives them."""
    for cp in [*range(0x558), *range(0x2010, 0x2070), *range(0x3040, 0x3097), *range(0x30A0, 0x3100), *range(0x4E00, 0x9FA6, 7)]:
        for text in (f"a{chr(cp)}a", f"1{chr(cp)}1", f"!{chr(cp)}{chr(cp)}!"):
            assert not prefix_counts.UNSURE.search(text)
            assert table.split(text) == [text[a:b] for _, (a, b) in table.library_split(text)], hex(cp)


def test_query(spark, sf, library):
    from tidymill.llm.registry import REGISTRY
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r)[:4] for r in REGISTRY["op13_token_counts"][0](spark, sf).collect())
    assert got == sorted((r.doc_id, len((r.text or "").encode()), library(r.text or ""), library(r.text or "") > 512) for r in docs)


def test_odd_rows_and_questions(spark, library):
    rows = [(1, None, [0, 5, None]), (2, "", None), (None, "a b", [-3, 1, 99]), (3, "it's 'll <|endoftext|> x", list(range(30))), (3, "it's", []), (4, "long words " * 20_000, [7, 200_000]), (5, "q" * 50_000, [50_000])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at array<int>, n_tokens int")
    got = {(r.doc_id, r.n_bytes): r for r in prefix_counts.count(df, PATH, limit=3).collect()}
    for i, text, _ in rows:
        text = text or ""
        row = got[i, len(text.encode())]
        assert (row.n_tokens, row.over_limit) == (library(text), library(text) > 3)
        assert library(text[:row.fit_chars]) <= 3
        assert all(library(text[:k]) > 3 for k in range(row.fit_chars + 1, min(len(text), row.fit_chars + 40) + 1))
    answers = sorted(map(str, (tuple(r) for r in prefix_counts.budget(df, PATH, "at").collect())))
    ends = lambda text, k: text[:max(0, min(k, len(text)))]
    assert answers == sorted(str((i, None if at is None else [None if k is None else library(ends(t or "", k)) for k in at])) for i, t, at in rows)
    cut = prefix_counts.truncate(df, PATH, limit=100).collect()
    assert len(cut) == len(rows) and all(library(r.text) == r.n_tokens <= 100 for r in cut)
    assert prefix_counts.count(df.limit(0), PATH).count() == 0
