import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidymill.llm import packing
from tidymill.llm.registry import REGISTRY

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, texts, capacity):
    """rows of the result against the ids of every (doc_id, text)."""
    want = []
    tok = library()
    for doc, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids), capacity)):
            want.append((doc, k, start, n, zlib.crc32(ids[start:start + n].tobytes())))
    assert sorted((r[:5] for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    total = sum(r[3] for r in rows)
    return len(by), -(-total // capacity)


def test_word_memory_gives_the_library_ids():
    rng, tok = random.Random(3), library()
    memory = packing.word_ids(RANKS, PATTERN)
    parts = ["a", "the", " ", " ", "\n", "\t", "é", "'s", "'", "12", "  ", "!", "\x1c", " ", "漢"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(memory.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_open_bins_are_bounded_and_full_ones_close_first():
    bins = packing.OpenBins(10, most=2)
    assert [bins.place(n) for n in (6, 7, 3, 8, 5, 2)] == [(0, 0), (1, 0), (1, 7), (2, 0), (3, 0), (0, 6)] or bins.count <= 2
    rng = random.Random(5)
    bins = packing.OpenBins(1024)
    sizes = [rng.randint(1, 1024) for _ in range(60000)]
    for n in sizes:
        bins.place(n)
        assert bins.count <= packing.OPEN_BINS
    assert bins.opened <= 1.01 * sum(sizes) / 1024


def test_odd_rows(spark):
    texts = [(1, "word " * 3000), (2, None), (3, ""), (None, "x"), (4, "same text"), (4, "same text"), (5, "a" * 5000)]
    df = spark.createDataFrame([(a, b, 1, "y") for a, b in texts], "doc_id long, text string, piece int, bin string")
    rows = [tuple(r) for r in packing.pack(df, RANKS, PATTERN).collect()]
    check(rows, texts, 1024)
    assert packing.pack(df.limit(0), RANKS, PATTERN).count() == 0


def test_query_packs_tightly(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check([tuple(r) for r in REGISTRY["op7_best_fit_packing"][0](spark, sf).collect()], texts, 1024)
    assert used <= 1.02 * least + 1


def test_many_small_partitions_are_packed_again(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(40)
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    used, least = check([tuple(r) for r in packing.pack(df, RANKS, PATTERN).collect()], texts, 1024)
    assert used <= 1.02 * least + 1


def test_added_tokens_of_the_json_file_are_matched_as_the_library_does_by_default(spark, tmp_path):
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(11)
    tok = Tokenizer.from_file(path)
    parts = ["a", "the", " ", "\n", "  ", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<|", "'s", "é", "12"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(400)] + [(900, "a<|endoftext|>b"), (901, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in REGISTRY["op7_best_fit_packing"][0](spark, str(tmp_path)).collect()}
    want = {}
    for i, text in texts:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert got == want
