import zlib

import zstandard

from tidymill.llm import toxicity
from tidymill.llm.registry import REGISTRY


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_isotonic_steps():
    assert toxicity.rising([(0, 0.1, 10), (1, 0.5, 1), (2, 0.3, 1), (5, 0.9, 2)]) == ((0, 1, 5), (0.1, 0.4, 0.9))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = REGISTRY["op5_toxicity"][0](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y, _ in test if y], [s for s, y, _ in test if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / len(good) / len(bad)
    assert auc > 0.65, auc
    assert sum(p for _, y, p in test if not y) <= 0.02 * len(bad)


def test_learns_from_marked_words_and_scores_odd_rows(spark):
    nice = [(i, f"the river number {i * 7919} runs along the old road and over the hill {i}", 0) for i in range(200)]
    foul = [(1000 + i, f"the river number {i * 104729} wretchedfool runs along the old road {i}", 1) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in nice + foul] + [(5000, None, "x"), (5001, "", "x"), (None, "wretchedfool", "x"), (5002, "a" * 100000, "x"), (5002, "a" * 100000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in nice + foul] + [(3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    got = {}
    for r in toxicity.score(docs, toxicity.train(docs, labels)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(got[i][0].predicted for i, _, _ in foul) > 190 and sum(got[i][0].predicted for i, _, _ in nice) == 0
    assert len(got[5002]) == 2 and got[5000][0].score == got[5001][0].score < 0.5
    assert not got[None][0].held_out
    none = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_rare_stems_of_another_language_tell_too(spark):
    """Every twentieth toxic document, and none of their words is in two of them: only the stem is."""
    ends = ["an", "est", "ilo", "ubra", "ona", "emi", "urt", "olde", "ista", "ang"]
    word = lambda i, k: "grumwo" + ends[(i + k) % 10] + ends[(i // 10 + 3 * k) % 10] + ends[(i // 7 + k) % 10]
    nice = [(i, f"the river number {i * 7919} runs along the old road and over the hill {i}", 0) for i in range(1500)]
    foul = [(5000 + i, f"the river number {i * 104729} wretchedfool runs along the old road {i}", 1) for i in range(1140)]
    rare = [(9000 + i, f"el rio {word(i, 0)} numero {i * 15485863} corre {word(i, 1)} por el viejo camino y sobre {word(i, 2)} la colina {i}", 1) for i in range(60)]
    calm = [(9500 + i, f"el rio numero {i * 15485863} corre por el viejo camino y sobre la colina {i}", 0) for i in range(400)]
    rows = nice + foul + rare + calm
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    found = lambda part: sum(model.score(t) >= toxicity.THRESHOLD for i, t, _ in part if held(i))
    assert found(rare) >= 0.8 * sum(held(i) for i, _, _ in rare)
    assert found(foul) >= 0.9 * sum(held(i) for i, _, _ in foul)
    assert found(nice) + found(calm) <= 2


def plain_total(model, text):
    """Sum over windows of eight words, one every four, each compressed by itself with compressors made for it alone."""
    found = [w[i:i + 64] for w in text.lower().encode().split() for i in range(0, len(w), 64)]
    params = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    total, at = 0.0, 0
    while found and (at == 0 or at < len(found) - 4):
        window = b" " + b" ".join(found[at:at + 8]) + b" "
        near, far = (len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=params).compress(window)) for d in (model.toxic, model.ordinary))
        total += model.evidence[min(len(model.evidence) - 1, max(0, far - near - model.lowest))]
        at += 4
    return total


def test_scores_against_plain_compression(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    rows = [(i, f"the river {i * 7919} runs along the old road {i}", 0) for i in range(300)] + [(1000 + i, f"the river {i * 104729} wretchedfool runs along the old road {i}", 1) for i in range(300)]
    model = toxicity.train(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(25).collect()] + ["", "one", "wretchedfool", "a b c d e f g h i", "wretchedfool " * 40, "x" * 300]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for row in got:
        total = plain_total(model, texts[row.doc_id])
        score = next((s for least, s in reversed(list(zip(model.sums, model.scores))) if least <= total), model.scores[0])
        assert abs(row.score - score) < 1e-12, texts[row.doc_id][:40]
    assert labels.count() > 0


def test_held_out_recall_per_language(spark):
    """Toxic documents of every language are found, and ordinary ones left alone."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    model, found = toxicity.train(docs, labels), {}
    for r in docs.join(labels.filter("toxic IS NOT NULL"), "doc_id").select("doc_id", "text", "lang", "toxic").collect():
        if held(r.doc_id):
            found.setdefault((r.lang, r.toxic), []).append(model.score(r.text or "") >= toxicity.THRESHOLD)
    recall = {k: sum(v) / len(v) for k, v in found.items()}
    assert all(recall[lang, 1] >= least for lang, least in (("en", 0.7), ("fr", 0.6), ("de", 0.5), ("es", 0.6))), recall
    ordinary = [hit for (_, toxic), hits in found.items() if not toxic for hit in hits]
    assert sum(ordinary) <= 0.01 * len(ordinary)
