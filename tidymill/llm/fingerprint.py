"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the words of a text (lower case, parted by white space), weighted 1 + ln(count). For each of 64 samples a term with
weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of the term alone; with t = floor(ln w / r + b) and
ln y = r (t - b), the sample is the term and t with the least ln c - ln y - r. Two texts agree in a sample with a probability
that equals their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.

The draws depend on the term and its count, not on the document. So among ROWS_PER_BLOCK neighbouring documents every (term, count) draws
once and hands its draws to the documents that hold it; a document keeps the least of each sample. What a pair of term and count gathers is
bounded at any size of the corpus. A pair that a text and its edited text share is handed out once, to both.

A sample's least value over terms of total weight W is exponential with rate W, and W is at least the number of different words. So draws are
handed to a text only if one of their eight lies below REACH over that number: a text misses none of its least values but with probability
exp(-REACH) a sample, 1e-14. Which draws a text gets depends on the text alone, so equal texts have equal fingerprints in that case too.

Tasks are ranges of doc_id of about ROWS_PER_TASK documents; rows of one frequent doc_id are parted further by the hash of their text. Counting,
drawing and taking minima all go by range and need no other shuffle. The driver holds one bound per range.

The next document, for the edited text, is the one that follows in the order of doc_id (null first), then the hash of the text, then the text; the
last is followed by the first. The first document of each range is also given to the range before it.

Defined results: a null text counts as empty; texts without words share one fingerprint of their own and have likeness 1 to each
other, 0 to others; equal texts have equal fingerprints; repeated rows are rows of their own; an empty table gives no rows; columns
other than doc_id and text are not read.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import pick, whole_text

#: Samples, as rows of so many columns.
GROUPS, WIDTH = 8, 8
ROWS_PER_BLOCK, ROWS_PER_TASK = 4000, 65_536
#: A text is handed draws below this over the number of its words.
REACH = 32.0
#: Stands for a text without words.
WORDLESS = "\x00"
#: Scale of the logarithm in a packed sample: 2^36 steps in the upper bits, 20 bits of term and t below.
STEP, LOW_BITS = float(1 << 36), 1 << 20
#: Levels of the number of different words: two to a doubling.
LEVELS, LEVEL = 128, math.log(2) / 2


def _unit(bits: Column) -> Column:
    """A number in (0, 1) from 31 bits."""
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 31))


def draw(term: Column, log_weight: Column, sample: Column) -> Column:
    """The sample's value for a term, packed into one long: smaller is better, equal only for the same term and t."""
    first, second, third = (F.xxhash64(term, sample, F.lit(k)) for k in range(3))
    low, high = (lambda h: h.bitwiseAND(F.lit((1 << 31) - 1))), (lambda h: F.shiftrightunsigned(h, 33))
    r = -F.ln(_unit(low(first)) * _unit(high(first)))
    log_c = F.ln(-F.ln(_unit(low(second)) * _unit(high(second))))
    b = _unit(low(third))
    t = F.floor(log_weight / r + b)
    value = log_c - r * (t.cast("double") - b) - r
    # ln c lies in (-22, 4) and the rest within a few hundred of it: 28 bits before the point are ample.
    packed = F.greatest(F.least(value, F.lit(120.0)), F.lit(-120.0)) * F.lit(STEP)
    return F.floor(packed).cast("long") * F.lit(LOW_BITS) + F.pmod(F.xxhash64(third, t), F.lit(LOW_BITS))


def _longs(values: list) -> Column:
    """An array of longs as one constant, however many they are."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _cuts(ids: DataFrame, ranges: int) -> list[int]:
    """Lower bounds of all ranges but the first, in ascending order; an id with many rows is found several times."""
    if ranges <= 1:
        return []
    shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    return sorted(ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 4 * ranges))).alias("p")).first()["p"] or [])


def _below(cuts: list[int], included: bool) -> Column:
    """How many bounds lie below the id (or at it): first among every root-th bound, then among those between."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = F.split(F.lit(";".join(",".join(map(str, cuts[i:i + step])) for i in range(0, len(cuts), step))), ";")
    count = lambda values: F.size(F.filter(values, lambda c: (c <= F.col("doc_id")) if included else (c < F.col("doc_id"))))
    group = count(_longs(cuts[::step]))
    inner = F.element_at(F.transform(groups, lambda g: F.split(g, ",").cast("array<bigint>")), F.greatest(group, F.lit(1)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + count(inner))


def _range_of(cuts: list[int]) -> Column:
    """Number of the range of a row. An id that is several bounds has as many ranges, by the hash of the text; the last of them goes on to further ids."""
    if not cuts:
        return F.lit(0)
    upto, below = _below(cuts, True), _below(cuts, False)
    part = F.floor(F.col("hash") / F.lit(float(1 << 63)) * (upto - below)).cast("int")
    spread = F.least(below + 1 + part, upto)
    return F.when(F.col("doc_id").isNull(), 0).when(upto - below > 1, spread).otherwise(upto).cast("int")


def _marked(docs: DataFrame, rows_per_task: int) -> tuple[Column, Column]:
    """Range of a row, and the range before it if the row is (one of) the first of its range, else null."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    # Where there are many tasks, more and smaller ranges keep all of them busy.
    ranges = max(1, min(rows // 16, max(-(-rows // rows_per_task), 2 * parts)))
    block, least = _range_of(_cuts(docs.select("doc_id"), ranges)), F.lit(-(1 << 63))
    key = F.struct(F.coalesce("doc_id", least).alias("id"), F.col("hash"))
    found = docs.select(block.alias("block"), key.alias("key")).groupBy("block").agg(F.min("key").alias("key")).orderBy("block").collect()
    if not found:
        return block, F.lit(None).cast("int")
    first_id, first_hash, before = ([None] * (found[-1]["block"] + 1) for _ in range(3))
    for i, row in enumerate(found):
        first_id[row["block"]], first_hash[row["block"]] = row["key"]
        before[row["block"]] = found[i - 1]["block"]
    at = lambda values: F.get(_longs(values), block)
    return block, F.when((key["id"] == at(first_id)) & (key["hash"] == at(first_hash)), at(before).cast("int"))


def fingerprint_with_edits(documents: DataFrame, rows_per_block: int = ROWS_PER_BLOCK, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    docs = (pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
            .withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1)))
    block, before = _marked(docs, rows_per_task)
    places = F.array_compact(F.array(F.struct(block.alias("block"), F.lit(False).alias("ghost")), F.when(before.isNotNull(), F.struct(before.alias("block"), F.lit(True).alias("ghost")))))
    dealt = docs.select(F.explode(places).alias("at"), "doc_id", "text", "hash").select("at.block", "at.ghost", "doc_id", "text", "hash")

    order = Window.partitionBy("block").orderBy("ghost", F.asc_nulls_first("doc_id"), "hash", "text")
    # Behind the last document of a range only the first of its ghosts is needed, for its own terms.
    placed = (dealt.withColumn("place", F.row_number().over(order)).withColumn("following", F.coalesce(F.lead("text").over(order), F.lit("")))
              .withColumn("spare", F.col("ghost") & F.lag("ghost", 1, False).over(order)).filter(~F.col("spare")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("following"), F.lit(1), half))
    texts = placed.withColumn("edited", F.when(F.col("ghost"), "").otherwise(edited))

    words = lambda column: F.split(F.when(F.col(column).rlike(r"\S"), F.lower(column)).otherwise(WORDLESS), r"\s+")
    level = lambda w: F.floor(F.log(F.size(F.array_except(w, F.array(F.lit("")))).cast("double")) / LEVEL).cast("int")
    # Words are split and their number is taken once a text, before they are parted into rows.
    versions = F.transform(F.array(words("text"), words("edited")), lambda w, i: F.struct(i.alias("version"), level(w).alias("level"), w.alias("words")))
    tokens = (texts.select("block", "place", F.explode(versions).alias("v")).select("block", "place", "v.version", "v.level", F.explode("v.words").alias("word")).filter("word <> ''"))
    of = lambda k, value, fn: fn(F.when(F.col("version") == k, value))
    counted = tokens.groupBy("block", "place", F.xxhash64("word").alias("term")).agg(
        *(of(k, F.lit(1), F.count).alias(f"n{k}") for k in (0, 1)), *(of(k, F.col("level"), F.max).alias(f"level{k}") for k in (0, 1)))
    # Holders of a document: 0 its text, 1 the edited text, 2 both.
    to = lambda kind, n, level, when: F.when(when, F.struct(F.col(n).alias("n"), ((F.col("place") * 3 + kind).cast("long") * LEVELS + level).alias("holder")))
    alike = F.col("n0") == F.col("n1")
    rows = F.array(to(2, "n0", F.least("level0", "level1"), alike), to(0, "n0", F.col("level0"), ~alike & (F.col("n0") > 0)), to(1, "n1", F.col("level1"), ~alike & (F.col("n1") > 0)))
    held = (counted.select("block", F.floor((F.col("place") - 1) / rows_per_block).cast("int").alias("sub"), "term", F.explode(rows).alias("r")).filter("r is not null")
            .select("block", "sub", "term", "r.n", "r.holder"))
    shared = held.groupBy("block", "sub", "term", "n").agg(F.collect_list("holder").alias("holders"))
    # GROUPS rows of WIDTH samples for each term and count: short enough to stay in compiled code.
    drawn = (shared.withColumn("g", F.explode(F.array(*(F.lit(g) for g in range(GROUPS))))).withColumn("log_weight", F.ln(1 + F.ln("n")))
             .select("block", "g", "holders", *(draw(F.col("term"), F.col("log_weight"), F.col("g") * WIDTH + j).alias(f"d{j}") for j in range(WIDTH)))
             .withColumn("low", F.least(*(f"d{j}" for j in range(WIDTH)))))
    unit = int(LEVEL * STEP) * LOW_BITS
    limit = F.lit(int(math.log(REACH) * STEP) * LOW_BITS) - F.pmod("h", F.lit(LEVELS)) * F.lit(unit)
    handed = (drawn.select("block", "g", "low", F.explode("holders").alias("h"), *(f"d{j}" for j in range(WIDTH))).filter(F.coalesce(F.col("low") < limit, F.lit(False)))     # no condition that would draw twice is inferred
              .select("block", "g", F.floor(F.col("h") / LEVELS).alias("holder"), *(f"d{j}" for j in range(WIDTH))))
    least = handed.groupBy("block", "holder", "g").agg(*(F.min(f"d{j}").alias(f"d{j}") for j in range(WIDTH)))
    of_both = least.groupBy("block", F.floor(F.col("holder") / 3).cast("int").alias("place"), "g").agg(
        *(F.min(F.when(F.col("holder") % 3 != 1 - k, F.col(f"d{j}"))).alias(f"v{k}_{j}") for k in (0, 1) for j in range(WIDTH)))
    nothing = F.lit((1 << 63) - 1)
    row = lambda k: F.array(*(F.coalesce(f"v{k}_{j}", nothing) for j in range(WIDTH)))
    gathered = of_both.groupBy("block", "place").agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct(row(0).alias("own"), row(1).alias("edited"))))).alias("s"))
    samples_of = lambda c: F.flatten(F.transform(F.array(*(F.lit(g) for g in range(GROUPS))), lambda g: F.coalesce(F.element_at("s", g)[c], F.array_repeat(nothing, WIDTH))))
    both = gathered.select("block", "place", *(samples_of(c).alias(c) for c in ("own", "edited")))

    samples = GROUPS * WIDTH
    likeness = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))
    packed = lambda s: F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))
    following = F.lead("own").over(Window.partitionBy("block").orderBy("place"))
    signs = (both.withColumn("following", F.coalesce(following, "own"))
             .select("block", "place", packed(F.col("own")).alias("own"), packed(F.col("edited")).alias("edited"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next")))
    facts = texts.filter(~F.col("ghost")).select("block", "place", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    return facts.join(signs, ["block", "place"]).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next")
