import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidymill.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, PATTERN)


def texts():
    rng = random.Random(1)
    words = ["the", " of", "  ", "\n", "'s", "'", "'r", "e", "x" * 40, "é", "ß", "漢字", "12", "3", "!!", "...", " ", "\x1c", "a'll", "🙂", "̀"]
    yield from ("", " ", "a", "\n" * 5000, "x" * 30000, " " * 9000 + "a", "ab" * 7000, "'" * 9000, "漢" * 9000, "1234567" * 2000)
    for n in (10, 1000, 4000, 9000):
        for _ in range(12):
            yield "".join(rng.choice(words) for _ in range(n))
    for alphabet in ("ab", "etaoinshr", "0123456789", "!?-=#"):
        yield "".join(rng.choice(alphabet) for _ in range(30000))


def test_tree_gives_the_library_ids(codec):
    for text in texts():
        ids = codec.encode(text)
        assert ids == codec.matches(text), text[:60]
        assert codec.decode(ids) == text.encode()


def test_small_leaves_and_windows(codec, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 3)
    monkeypatch.setattr(bpe, "LONG_MATCH", 4)
    for text in texts():
        text = text[:3000]
        assert codec.encode(text) == codec.matches(text), text[:60]


def test_query_over_odd_rows(spark):
    rows = [(1, "hello world", 5), (1, "hello world", 5), (2, None, 1), (None, "", 1), (3, "<|endoftext|> it's", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    library = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=dict(zip(bpe.codec(RANKS, PATTERN).bytes_of, range(50256))), special_tokens={})
    want = set()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(df, RANKS, PATTERN).count() == 5
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0
