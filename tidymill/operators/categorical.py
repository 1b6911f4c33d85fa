"""Boolean, category, status, survey and multi-value columns."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions.fixed_values import (CATEGORY_ACRONYMS, FALSE_WORDS, FREQUENCY_WORDS, LIKERT_5, LIKERT_7, MULTI_DELIMITERS,
                                      NON_BINARY_WORDS, SATISFACTION_WORDS, STATUS_WORDS, SURVEY_TYPOS, TRUE_WORDS, WORKFLOWS)
from ..functions.text import folded, is_upper, lookup, number, replace_all, squeeze, title_keeping
from ..functions.udfs import nfkc
from .rules import ColumnRules, count_nulls, null_note, rare_rows, value_counts
from .similarity import apply_variants, checkpointer, similar_to, variant_groups


def boolean_rules(column, as_number=False):
    key = lambda c: F.regexp_replace(folded(c.v.cast("string")), r"\.0$", "")
    r = (ColumnRules(column)
         .flag("BOOL-02", lambda c: folded(c.v.cast("string")).isin(*NON_BINARY_WORDS))
         .flag("BOOL-01", lambda c: c.v.isNotNull() & ~key(c).isin(*TRUE_WORDS, *FALSE_WORDS, *NON_BINARY_WORDS))
         .change("BOOL-01", lambda c: F.when(key(c).isin(*TRUE_WORDS), True).when(key(c).isin(*FALSE_WORDS), False))
         .measure(nulls=count_nulls, false=lambda c: F.count_if(~c.v))
         .note("BOOL-03", lambda s: f"{s['nulls']} missing, {s['false']} false" if s.get("nulls") else None))
    if as_number:
        r.change("BOOL-04", lambda c: c.v.cast("int"))
    return r


def category_case(v):
    return F.when(is_upper(v) & (F.length(v) <= 5), v).otherwise(title_keeping(v, CATEGORY_ACRONYMS))


_MARKS = [("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2014", "-"), ("\u2013", "-"), ("\u00a0", " ")]


def compatibility_forms(frame, column, out):
    """CAT-08: NFKC. Only distinct values with other than ASCII characters can change, so only they reach Python."""
    special = frame.select(F.col(f"`{column}`").alias("value")).filter(F.col("value").rlike(r"[^\x00-\x7F]")).distinct()
    return apply_variants(frame, column, special.select("value", nfkc("value").alias("canonical")), out)


def most_frequent_spelling(frame, column, out):
    """CAT-02: values equal up to case and blanks take their most frequent spelling (ties: the smallest)."""
    counts = value_counts(frame, column).withColumn("key", folded(F.col("value")))
    best = counts.groupBy("key").agg(F.max_by("value", F.struct("n", F.col("value"))).alias("canonical"), F.count("*").alias("spellings"))
    pairs = (counts.join(best.filter("spellings > 1"), "key").filter("value <> canonical").select("value", "canonical"))
    return apply_variants(frame, column, pairs, out)


def correct_rare_values(frame, column, out, threshold=0.85):
    """CAT-03: a value below 2 % and below 5 rows becomes the most similar established value, if the ratio exceeds 0.85."""
    counts = checkpointer(frame.sparkSession)(value_counts(frame, column).withColumn("key", F.lower("value")))
    total = counts.agg(F.sum("n")).scalar()
    counts = counts.withColumn("settled", (F.col("n") >= 0.02 * total) | (F.col("n") >= 5))
    rare, known = counts.filter("not settled"), counts.filter("settled")
    scored = similar_to(rare.select("key").distinct(), known.select("key").distinct(), threshold).filter(F.col("ratio") > threshold)
    best = scored.groupBy("a").agg(F.max_by("b", F.struct("ratio", "b")).alias("b"))
    spelled = known.groupBy("key").agg(F.max_by("value", F.struct("n", "value")).alias("canonical"))
    pairs = (rare.join(best, rare["key"] == best["a"]).select("value", "b")
             .join(spelled, F.col("b") == F.col("key")).select("value", "canonical"))
    return apply_variants(frame, column, pairs, out)


def category_rules(column, typos=True):
    r = (ColumnRules(column)
         .change("CAT-07", lambda c: squeeze(c.v))
         .change("CAT-08", lambda c: replace_all(c.v, _MARKS))
         .join("CAT-08", compatibility_forms)
         .change("CAT-01", lambda c: category_case(c.v))
         .join("CAT-02", most_frequent_spelling))
    if typos:
        r.join("CAT-03", correct_rare_values)
    rule, text = null_note("CAT-06")
    return (r.measure(nulls=count_nulls).note(rule, text)
            .keyed_flag("CAT-04", lambda frame, v, cur: rare_rows(frame, v, 0.01)))


def category_report(df, column):
    """CAT-05: distinct values with counts."""
    return value_counts(df, column)


def status_rules(column):
    """STAT-02 learns the workflow from the statuses that occur; at most one row per workflow step comes back."""
    named = sorted({s for steps in WORKFLOWS.values() for s in steps})
    present = {s: (lambda c, s=s: F.max(c.v == s)) for s in named}

    def workflow(stat):
        overlap = {w: sum(bool(stat.get(s)) for s in steps) for w, steps in WORKFLOWS.items()}
        best = max(overlap, key=lambda w: overlap[w])
        return best if overlap[best] else None

    def outside(c):
        flow = workflow(c.stat)
        known = sorted(set(STATUS_WORDS.values()))
        return c.v.isin(*known) & ~c.v.isin(*WORKFLOWS[flow]) if flow else F.lit(False)

    return (ColumnRules(column)
            .change("STAT-03", lambda c: F.initcap(squeeze(c.v)))
            .change("STAT-01", lambda c: lookup(STATUS_WORDS, folded(c.v), c.v))
            .measure(**present)
            .flag("STAT-02", outside)
            .flag("STAT-04", lambda c: c.v.isNull())
            .keyed_flag("STAT-05", lambda frame, v, cur: rare_rows(frame, v, 0.01))
            .note("STAT-02", lambda s: f"workflow {workflow(s)}" if workflow(s) else None))


def likert_scale(stat):
    """SURV-01: (name, size, words) of the answer scale. Numbers decide it only where they are not outnumbered by known words."""
    lo, hi = stat.get("lo"), stat.get("hi")
    if lo is not None and lo >= 1 and (stat.get("numbers") or 0) >= (stat.get("verbal") or 0):
        for name, size in (("numeric_5", 5), ("numeric_7", 7), ("numeric_10", 10)):
            if hi <= size:
                return name, size, {}
    if stat.get("likert"):
        return ("agree_7", 7, LIKERT_7) if stat.get("somewhat") else ("agree_5", 5, LIKERT_5)
    if stat.get("frequency"):
        return "frequency", 5, FREQUENCY_WORDS
    if stat.get("satisfaction"):
        return "satisfaction", 5, SATISFACTION_WORDS
    return "unknown", 0, {}


def survey_rules(column, with_columns=()):
    """``with_columns``: the other answers of the same questionnaire; three or more equal ones are straight-lining."""
    key = lambda c: folded(c.v.cast("string"))
    seen = lambda ws: lambda c: F.max(key(c).isin(*ws))
    numeric = lambda c: number(F.trim(c.v.cast("string")))

    def scored(c):
        _, _, words = likert_scale(c.stat)
        fixed = lookup(SURVEY_TYPOS, key(c), key(c))
        value = F.coalesce(lookup(words, fixed), lookup(FREQUENCY_WORDS, fixed)) if words else lookup(FREQUENCY_WORDS, fixed)
        return F.coalesce(numeric(c), value.cast("double"))

    def out_of_range(c):
        _, size, words = likert_scale(c.stat)
        if not size:
            return F.lit(False)
        unknown = c.v.isNotNull() & c.get("score").isNull() if words else F.lit(False)
        return (c.get("score") < 1) | (c.get("score") > size) | unknown

    def straight(c):
        answers = F.array_compact(F.array(*[folded(F.col(f"`{x}`").cast("string")) for x in (column, *with_columns)]))
        return (F.size(answers) >= 3) & (F.size(F.array_distinct(answers)) == 1)

    r = (ColumnRules(column)
         .measure(lo=lambda c: F.min(numeric(c)), hi=lambda c: F.max(numeric(c)), likert=seen(LIKERT_5), frequency=seen(FREQUENCY_WORDS),
                  somewhat=seen(("somewhat agree", "somewhat disagree")), numbers=lambda c: F.count(numeric(c)),
                  verbal=lambda c: F.count_if(key(c).isin(*{**LIKERT_5, **LIKERT_7, **FREQUENCY_WORDS, **SATISFACTION_WORDS, **SURVEY_TYPOS})), satisfaction=seen(SATISFACTION_WORDS), nulls=count_nulls)
         .change("SURV-03", lambda c: F.coalesce(F.initcap(lookup(SURVEY_TYPOS, key(c))), c.v.cast("string")))
         .let("score", scored)
         .derive("SURV-02", "score", lambda c: c.get("score"))
         .note("SURV-04", lambda s: "answers of frequency, scored 1 to 5" if likert_scale(s)[0] == "frequency" else None)
         .flag("SURV-05", out_of_range)
         .note("SURV-01", lambda s: f"scale {likert_scale(s)[0]}")
         .note(*null_note("SURV-07")))
    if len(with_columns) >= 2:
        r.flag("SURV-06", straight)
    return r


# ---- several values in one cell ----------------------------------------------------------------------------------------

def delimiter_stats(df, column):
    """MULTI-01: occurrences of every delimiter and the share of non-null cells that hold it, one row per delimiter."""
    v = F.col(column)
    wide = df.agg(*[x for d in MULTI_DELIMITERS for x in (
        F.sum((F.length(v) - F.length(F.replace(v, F.lit(d), F.lit("")))) / len(d)).cast("long"),
        F.count_if(F.contains(v, F.lit(d))))], F.count(v))
    row = wide.first()
    n = row[len(row) - 1]
    rows = [(d, int(row[2 * i] or 0), round(row[2 * i + 1] / n, 4) if n else 0.0) for i, d in enumerate(MULTI_DELIMITERS)]
    return df.sparkSession.createDataFrame(rows, "delimiter string, occurrences bigint, cell_share double")


def detect_delimiter(stats, least=0.2):
    """MULTI-01: the most frequent delimiter and whether the column counts as multi-value."""
    best = stats.filter("occurrences > 0").agg(F.max_by(F.struct("delimiter", "cell_share"), F.struct("occurrences", F.col("delimiter"))).alias("b"))
    return best.select(F.col("b.delimiter").alias("delimiter"), (F.col("b.cell_share") >= least).alias("is_multi_value"))


def split_values(v):
    """All delimiters at once; parts trimmed, empty parts dropped."""
    return F.filter(F.transform(F.split(v, r"[,;|/&\n]|\\n| and "), lambda p: F.trim(p)), lambda p: p != "")


def _joined(parts):
    return F.array_join(parts, ", ")


def multi_value_rules(column, variants=True):
    r = (ColumnRules(column)
         .change("MULTI-02", lambda c: F.when(c.v.rlike(r"[;|/&\n]|\\n| and "), _joined(split_values(c.v))).otherwise(c.v))
         .change("MULTI-03", lambda c: F.when(c.v.isNotNull(), _joined(F.transform(split_values(c.v), lambda p: category_case(squeeze(p)))))))
    if variants:
        r.join("MULTI-04", merge_part_variants)
    return r


def exploded(df, column, out="value"):
    """MULTI-05: one row per part; rows without a part are kept with null."""
    return df.select("*", F.explode_outer(split_values(F.col(column))).alias(out))


def part_counts(df, column):
    """MULTI-06, MULTI-07: parts with their counts."""
    return (df.select(F.explode(split_values(F.col(column))).alias("value")).groupBy("value").agg(F.count("*").alias("n")))


def explosion_size(df, column):
    """MULTI-05: rows now, and rows after one row per part."""
    return df.agg(F.count("*").alias("current_rows"), F.sum(F.size(split_values(F.col(column)))).alias("exploded_rows"))


def merge_part_variants(frame, column, out, threshold=0.85, rid="_rid"):
    """MULTI-04: parts with a ratio of at least 0.85 take one spelling.

    Only rows that hold a part to be changed are exploded and rebuilt; the rest pass through.
    """
    parts = frame.select(F.explode(split_values(F.col(f"`{column}`"))).alias("part")).distinct()
    groups = variant_groups(parts, "part", threshold, pick="first").filter("value <> canonical")
    exploded_rows = frame.select(F.col(rid).alias("_k"), F.posexplode(split_values(F.col(f"`{column}`"))).alias("_p", "value"))
    touched = exploded_rows.join(groups, "value", "left_semi").select("_k").distinct()
    rebuilt = (exploded_rows.join(touched, "_k", "left_semi").join(groups, "value", "left")
               .groupBy("_k").agg(_joined(F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("canonical", "value").alias("v")))),
                                                      lambda s: s["v"])).alias("_new")))
    return (frame.join(rebuilt, F.col(rid) == F.col("_k"), "left")
            .withColumn(out, F.coalesce("_new", F.col(f"`{column}`"))).drop("_k", "_new"))
