from collections import Counter

import corpus_pipeline as p
import public_tokenizers
from tidymill.llm import language, packing, toxicity
from tidymill.llm.frames import table

from .test_jaccard import brute
from .test_packing import check


def test_rows_against_a_plain_version(spark, sf):
    docs = table(spark, sf, "documents")
    network = language.train(docs)
    rows = docs.collect()
    kept = [r for r in rows if (x := language.languages_of(network, [r.text or ""])[0])[0] != "und" and x[1] >= p.LEAST_SCORE]
    first = spark.createDataFrame(kept, docs.schema)
    model = toxicity.train(first, table(spark, sf, "labels"))
    kept = [(r.doc_id, r.text) for r in kept if model.score(r.text) < toxicity.THRESHOLD]
    classes = {i: c for i, c, _ in brute(kept)}
    kept = [(i, t) for i, t in kept if classes[i] == i]
    got = [tuple(r) for r in p.run(spark, sf).collect()]
    assert Counter(r[0] for r in got if r[1] == 0) == Counter(i for i, _ in kept)
    used, least = check(got, kept, 1024)
    assert used <= 1.02 * least + 1


def test_stages_keep_columns_and_survive_odd_rows(spark, sf):
    own = table(spark, sf, "documents").limit(60).collect()
    rows = [(*r, 0.5, "und", 7) for r in own]
    rows += [(9001, None, None, None, None, None, None, None), (9002, "", "en", "s", 0, 0.1, "x", 1), (None, own[0].text, "en", "s", 1, 0.1, "x", 1), (None, "The and of the that was here.", None, "s", 1, 0.1, "x", 1), (own[1].doc_id, own[1].text, "en", "s", 1, 0.1, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, c0 int")
    names = df.columns
    for _, stage in p.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == names
        df = spark.createDataFrame(df.collect(), df.schema)
    ids = [r.doc_id for r in df.collect()]
    assert len(ids) == len(set(ids)) and 9001 not in ids and 9002 not in ids and None in ids
    assert p.STAGES[-1][1](spark, df, sf).select("doc_id").distinct().count() == len(ids)
    empty = df.limit(0)
    for _, stage in p.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
    assert [len(packing.cut(n, 1024)) for n in (1, 1024, 1025)] == [1, 1, 2] and public_tokenizers.PATTERN
