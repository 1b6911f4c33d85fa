import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from tidymill.llm import fingerprint
from tidymill.llm.registry import REGISTRY


def edits(rows):
    """rows of (doc_id, text, hash of the text)"""
    rows = [r[:2] for r in sorted(((i, t or "", h) for i, t, h in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))]
    out = []
    for k, (i, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(k + 1) % len(rows)][1]
        out.append((i, text, text[:len(text) - half] + after[:half], after))
    return out


def jaccard(a, b):
    x, y = ({w: 1 + math.log(n) for w, n in Counter(t.lower().split()).items()} for t in (a, b))
    if not x or not y:
        return float(x == y)
    return sum(min(x.get(w, 0), y.get(w, 0)) for w in {*x, *y}) / sum(max(x.get(w, 0), y.get(w, 0)) for w in {*x, *y})


def check(df, rows_per_block=50, rows_per_task=50):
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    rows = [tuple(r) for r in df.select("doc_id", "text", hashed).collect()]
    got = [tuple(r) for r in fingerprint.fingerprint_with_edits(df, rows_per_block, rows_per_task).collect()]
    want = edits(rows)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((g[0], g[1], g[2]) for g in got) == Counter((i, len(t), digest(e)) for i, t, e, _ in want)
    return got, want


def test_rate_of_equal_samples_is_the_weighted_jaccard(spark):
    a, b = {"x%d" % i: 1 + i % 5 for i in range(60)}, {"x%d" % i: 1 + (i * 3) % 7 for i in range(20, 80)}
    rows = spark.createDataFrame([(d, w, float(n)) for d, m in (("a", a), ("b", b)) for w, n in m.items()], "d string, w string, n double")
    drawn = rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3999)))).withColumn("v", fingerprint.draw(F.xxhash64("w"), F.ln("n"), F.col("s")))
    same = drawn.groupBy("d", "s").agg(F.min("v").alias("v")).groupBy("s").agg((F.countDistinct("v") == 1).cast("int").alias("same")).agg(F.avg("same")).first()[0]
    true = sum(min(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}) / sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
    assert abs(same - true) < 0.03


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, want = check(docs)
    texts = {i: (t, e, n) for i, t, e, n in want}
    near = [(g[5] - jaccard(texts[g[0]][0], texts[g[0]][1]), g[6] - jaccard(texts[g[0]][0], texts[g[0]][2])) for g in got]
    assert sum(abs(x) for x, _ in near) / len(near) < 0.06 and sum(abs(y) for _, y in near) / len(near) < 0.06
    assert max(abs(x) for x, _ in near) < 0.3
    assert abs(sum(x for x, _ in near)) / len(near) < 0.02
    by_text = {}
    for g in got:
        assert by_text.setdefault(texts[g[0]][0], g[3]) == g[3]
    assert sorted(map(str, got)) == sorted(map(str, (tuple(r) for r in REGISTRY["op3_document_fingerprints"][0](spark, sf).collect())))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (4, "a b"), (None, "null id"), (None, None), (-5, "x"), (1 << 62, "y z"), (7, "word " * 30000)] + [(9, "hot")] * 40
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, block string, place int")
    got, _ = check(df, 3, 3)
    check(df, 1000, 1000)
    empty = {g[3] for g in got if g[1] == 0}
    assert len(empty) == 1
    assert fingerprint.fingerprint_with_edits(df.limit(0)).count() == 0
    (one,), _ = check(df.filter("doc_id = 7"))
    assert one[6] == 1.0


def test_one_id_holds_a_third_of_the_rows(spark):
    """The id is parted by the hash of its texts, and each range still knows what follows."""
    rows = [(i, f"w{i} common words of {i % 7}") for i in range(300)] + [(40, f"hot text number {k} {'x' * (k % 5)}") for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))
    block, _ = fingerprint._marked(df, 20)
    sizes = {r["b"]: r["count"] for r in df.filter("doc_id = 40").groupBy(block.alias("b")).count().collect()}
    assert len(sizes) >= 5 and max(sizes.values()) < 60
    ends = df.groupBy(block.alias("b")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).orderBy("b").collect()
    assert all(a.high <= b.low for a, b in zip(ends, ends[1:]))
    check(df.drop("hash"), 7, 20)


def test_texts_miss_no_least_value(spark, sf, monkeypatch):
    """Handing out every draw gives the same fingerprints; a reach far too short is still defined."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 40)).otherwise(F.substring("text", 1, 3000)).alias("text"))
    rows = lambda: sorted(map(tuple, fingerprint.fingerprint_with_edits(docs).collect()))
    usual = rows()
    monkeypatch.setattr(fingerprint, "REACH", 1e12)
    assert rows() == usual
    monkeypatch.setattr(fingerprint, "REACH", 0.5)
    short = rows()
    assert [r[:3] for r in short] == [r[:3] for r in usual] and all(r[5] is not None and len(r[3]) == 512 for r in short)
