"""Bounded samples of labelled documents for the classifiers that are fitted on the driver."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents with this remainder of crc32 are held out.
FOLDS, HELD_OUT = 3, 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def bounded_sample(labelled: DataFrame, per_label: int) -> DataFrame:
    """At most per_label of the rows (doc_id, label) of each label: the first by a hash, one in each of per_label parts. Counts combine before the shuffle, so a frequent label is no hot key."""
    key = F.xxhash64(F.col("doc_id"))
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(per_label))
    return labelled.groupBy("label", part.alias("part")).agg(F.min_by("doc_id", key).alias("doc_id")).select("doc_id", "label")


#: Code points of a sampled text that a classifier is fitted on, at most.
MOST_CHARACTERS = 50_000


def texts_of(docs: DataFrame, sample: DataFrame) -> list[tuple[str, object]]:
    """(text, label) of the sampled documents, in an order of their own, one text (the least) of an id that has several: the sample is bounded in ids, rows and size, so it may reach the driver."""
    labels = {r["doc_id"]: r["label"] for r in sample.collect()}
    if not labels:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(labels)], docs.select("doc_id").schema)
    chosen = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.substring("text", 1, MOST_CHARACTERS).alias("text"))
    rows = chosen.groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["text"], labels[r["doc_id"]]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))]
