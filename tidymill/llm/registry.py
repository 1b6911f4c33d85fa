"""Queries of the operators in this package: name -> (query, its SQL or None)."""
from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, chat, cover_tree, fill_in_middle, fingerprint, html_text, importance, jaccard, language, licences, packing, prefix_counts, toxicity
from .frames import pick, table

REGISTRY = {}


def query(name, sql=None):
    def register(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return register


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op2_html_extraction")
def op2(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op3_document_fingerprints")
def op3(spark, sf_dir):
    return fingerprint.fingerprint_with_edits(table(spark, sf_dir, "documents"))


@query("op4_embedding_near_dedup")
def op4(spark, sf_dir):
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op6_language_id")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@query("op8_chat_formatting")
def op8(spark, sf_dir):
    spoken = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(spoken).alias("text"))
    turns = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.parse(chat.format_conversations(turns)))


@query("op9_ngram_jaccard_join")
def op9(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_license_scans")
def op10(spark, sf_dir):
    """A document is a file of its source: /source/shard/doc_id.txt with a thousand documents a shard."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"), keep=("doc_id",))


def crc32_table() -> list[int]:
    """crc32's register after one byte of each value, for the SQL below."""
    found = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        found.append(value)
    return found


OP11_SQL = rf"""
WITH corpus AS (SELECT doc_id, row_number() OVER () AS place, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
target AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
corpus_runs AS (SELECT place, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f FROM corpus),
target_runs AS (SELECT unnest(list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS f FROM target),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM corpus_runs UNION SELECT f FROM target_runs)),
hashed AS (SELECT f, xor(list_reduce([CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) for i in range(0, len(x) // 2)], lambda c, b: xor(c >> 8, {crc32_table()}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM hexed),
s AS (SELECT bucket, count(*) AS n FROM corpus_runs JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_runs JOIN hashed USING (f) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM corpus_runs) + 10000.0::DOUBLE) / ((s.n + 1.0::DOUBLE) * ((SELECT count(*) FROM target_runs) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT place, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM corpus_runs JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY place),
scored AS (SELECT doc_id, place, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM corpus LEFT JOIN weights USING (place)),
drawn AS (SELECT place, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (place)
"""

OP12_SQL = r"""
WITH units AS (SELECT coalesce(text, '') AS text, doc_id, sha256('42:' || doc_id) AS d, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u FROM documents),
drawn AS (SELECT *, len(u) AS n, [CAST('0x' || substr(d, 1 + 8 * i, 8) AS BIGINT) for i in range(0, 4)] AS h FROM units),
formed AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parted AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parted
"""


@query("op11_importance_resampling", OP11_SQL)
def op11(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_fill_in_middle", OP12_SQL)
def op12(spark, sf_dir):
    return fill_in_middle.digests(fill_in_middle.transform(table(spark, sf_dir, "documents")))


@query("op13_token_counts")
def op13(spark, sf_dir):
    return prefix_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
