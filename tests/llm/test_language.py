import zlib

import numpy as np

from tidymill.llm import language
from tidymill.llm.registry import REGISTRY


def test_gradients_against_differences():
    network = language.fresh(["a", "b", "c"], hidden=3)
    network.weights = [w.astype(np.float64) for w in network.weights]
    found, labels = [b"ab 12", "über!".encode(), b"x"], np.array([0, 2, 1])
    _, gradients = network.loss_and_gradients(found, labels)
    rng = np.random.default_rng(0)
    for w, g in zip(network.weights, gradients):
        places = [np.unravel_index(int(i), w.shape) for i in rng.permutation(w.size)[:20]] + [tuple(x) for x in np.argwhere(np.abs(g) > 0)[:10]]
        for at in places:
            kept, eps = w[at], 1e-5
            w[at] = kept + eps
            up, _ = network.loss_and_gradients(found, labels)
            w[at] = kept - eps
            down, _ = network.loss_and_gradients(found, labels)
            w[at] = kept
            assert abs((up - down) / (2 * eps) - g[at]) < 1e-6 + 1e-3 * abs(g[at])


def plain_labels(network, data):
    """One pass over all bytes from each side, byte by byte."""
    a, b, c, d, out, bias = (w.astype(np.float64) for w in network.weights)
    hidden = b.shape[0]

    def states(table, recurrent, order):
        h, found = np.zeros(hidden), {}
        for k in order:
            given, back = table[data[k]], h @ recurrent
            reset, update = np.split(np.clip((given + back)[:2 * hidden] / 4 + 0.5, 0, 1), 2)
            h = h + update * (np.clip(given[2 * hidden:] + reset * back[2 * hidden:], -1, 1) - h)
            found[k] = h
        return found

    ahead, behind = states(a, b, range(len(data))), states(c, d, range(len(data) - 1, -1, -1))
    p = np.exp(np.array([np.concatenate([ahead[k], behind[k]]) @ out + bias for k in range(len(data))]))
    return p / p.sum(axis=1, keepdims=True)


def test_stretches_against_one_pass_over_the_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(50).collect()
    network = language.fit([(r.text, r.lang) for r in docs if r.text and r.lang], steps=150)
    texts = [(r.text or "").lower().encode() for r in docs]
    assert any(len(t) > 2 * language.STRETCH for t in texts)
    same = total = 0
    for text, sums in zip(texts, network.sums(texts)):
        if not text:
            continue
        parts = language.stretches(text)
        labelled = np.concatenate([network.probabilities([s])[low:high, 0] for s, low, high in parts])
        assert len(labelled) == len(text) and np.allclose(labelled.sum(axis=0), sums, rtol=1e-3)
        plain = plain_labels(network, text)
        same, total = same + int((plain.argmax(axis=1) == labelled.argmax(axis=1)).sum()), total + len(text)
        assert plain.sum(axis=0).argmax() == sums.argmax()
    assert same >= 0.995 * total


def test_padding_and_batches_change_nothing():
    network = language.fresh(["a", "b", "c"], hidden=5)
    texts = [b"", b"x", b"abc 12!", "über ñ".encode() * 40, b"long text " * 300]
    alone = np.array([network.sums([t])[0] for t in texts])
    assert np.allclose(network.sums(texts), alone, rtol=1e-4, atol=1e-5)
    assert np.allclose(alone.sum(axis=1), [len(t) for t in texts], rtol=1e-4)
    for text in texts[1:4]:
        one = network.probabilities([text])[:, 0]
        assert np.allclose(one, plain_labels(network, text), atol=1e-4)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = REGISTRY["op6_language_id"][0](spark, sf).collect()
    assert len(rows) == len(true)
    test = [r for r in rows if r.held_out]
    assert {r.doc_id for r in test} == {i for i in true if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == true[r.doc_id] for r in test) >= 0.98 * len(test)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    texts = [(i, f"the house {i} and the garden", "en") for i in range(60)] + [(100 + i, f"das haus {i} und der garten", "de") for i in range(60)]
    odd = [(500, None, "en"), (501, "", None), (502, "123 !!", "de"), (None, "the house", "en"), (503, "the " * 30000, None), (504, "x" * 100000, None), (504, "x" * 100000, None)]
    df = spark.createDataFrame([(*r, "z", 1.0) for r in texts + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    got = language.predict(df, language.train(df)).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(texts) + len(odd)
    assert by[500] == by[501] == by[502] == "und" and by[503] == by[None] == "en"
    assert sum(by[i] == lang for i, _, lang in texts) >= 118
    hot = df.unionByName(spark.range(400).selectExpr("1 AS doc_id", "'das haus und der garten ' || id AS text", "'en' AS lang", "'z' AS lang_pred", "1.0 AS score"))
    assert len(language.texts_of(hot.select("doc_id", "text"), language.bounded_sample(hot.filter("lang = 'en' AND doc_id IS NOT NULL").selectExpr("doc_id", "lang AS label"), 100))) <= 100
    none = language.train(df.filter("lang = 'fr'"))
    assert none is None and {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}
    assert language.predict(df.limit(0), none).count() == 0
