"""Rules for the table as a whole: names, encoding, empty and summary rows, sparse columns, mixed types."""
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.fixed_values import DATE_LIKE_PATTERN, HEADER_TYPOS, MOJIBAKE, PII_WORDS, SUMMARY_WORDS
from ..functions.text import folded, let, number, replace_all
from ..plans import ordered
from ..plans.storage import stored
from .rules import ColumnRules, apply_rules

TYPES = ("integer", "float", "boolean", "date", "string")


def text_columns(df, rid="_rid"):
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != rid]


# ---- names -----------------------------------------------------------------------------------------------------------

def normal_name(name):
    """GLOBAL-03, GLOBAL-12: snake_case, without byte order mark, with common header typos corrected."""
    name = re.sub(r"[\s\-]+", "_", name.replace("﻿", "").strip().lower())
    name = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", name)).strip("_")
    return "_".join(HEADER_TYPOS.get(t, t) for t in name.split("_")) or name


def unique_names(names):
    """GLOBAL-04: the second and later use of a name get _1, _2, ..."""
    seen, out = {}, []
    for n in names:
        seen[n] = seen.get(n, -1) + 1
        out.append(n if not seen[n] else f"{n}_{seen[n]}")
    return out


def with_normal_names(df, rid="_rid"):
    new = unique_names([c if c == rid else (normal_name(c) or c) for c in df.columns])
    return df.toDF(*new), {o: n for o, n in zip(df.columns, new) if o != n}


def pii_tags(columns):
    """GLOBAL-10: (column, level) where all words of a registered term occur as whole tokens of the name."""
    def level(column):
        tokens = set(re.split(r"[_\W]+", column.lower()))
        return next((lv for lv, terms in PII_WORDS.items() if any(set(t.split("_")) <= tokens for t in terms)), None)
    return [(c, level(c)) for c in columns if level(c)]


# ---- cells and rows ------------------------------------------------------------------------------------------------------

def without_mojibake(v):
    """Every broken sequence begins with one of two letters; texts without them are left alone."""
    starts = sorted({old[0] for old, _ in MOJIBAKE})
    return F.when(reduce(lambda a, b: a | b, [F.contains(v, F.lit(s)) for s in starts]), replace_all(v, MOJIBAKE)).otherwise(v)


def cell_rules(column):
    return (ColumnRules(column)
            .change("GLOBAL-11", lambda c: without_mojibake(c.v))
            .change("GLOBAL-12", lambda c: F.replace(c.v, F.lit("﻿"), F.lit("")))
            .change("GLOBAL-14", lambda c: F.regexp_replace(c.v, r"^'(?=[^\p{Ll}])", ""))
            .change("GLOBAL-15", lambda c: F.when(F.regexp_replace(c.v, r"\s", "") != "", c.v)))


def drop_reason(columns, texts, header):
    """Rule that removes a row: empty, a summary line, or a repeat of the header; null keeps it.

    Every column is mentioned once, as it may be an expression of many steps that the optimizer copies to each mention.
    """
    names = F.array(*[F.lit(h) for h in sorted({h.lower().strip() for h in header})])

    def reason(row):
        cells = [row.getField(f"c{i}") for i in range(len(columns))]
        empty = reduce(lambda a, b: a & b, [c.isNull() for c in cells])
        summary = reduce(lambda a, b: a | b, [F.coalesce(cells[columns.index(c)].isin(*SUMMARY_WORDS), F.lit(False)) for c in texts], F.lit(False))
        shared = F.size(F.array_intersect(F.array_distinct(F.array_compact(F.array(*cells))), names))
        return F.when(empty, "GLOBAL-05").when(summary, "GLOBAL-07").when(shared >= 0.8 * len({h.lower() for h in header}), "GLOBAL-08")

    return let(F.struct(*[F.lower(F.trim(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(columns)]), reason)


def rows_to_drop(df, rid="_rid", header=None):
    """(kept rows, dropped rows with the rule that drops them). The marked table is stored once: both parts and all that is worked out from them read it."""
    cols = [c for c in df.columns if c != rid]
    marked = stored(df.withColumn("_drop", drop_reason(cols, text_columns(df, rid), header or cols)), "marked")
    return marked.filter("_drop is null").drop("_drop"), marked.filter("_drop is not null").select(F.col(rid).alias("_rid"), F.col("_drop").alias("rule"))


def sparse_rows(df, rid="_rid"):
    """GLOBAL-06: with four or more columns, rows that are more than 80 % null and hold at most two values."""
    cols = [c for c in df.columns if c != rid]
    if len(cols) < 4:
        return df.select(F.col(rid).alias("_rid")).filter("false")
    filled = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNotNull().cast("int") for c in cols])
    return df.filter((filled <= 2) & (len(cols) - filled > 0.8 * len(cols))).select(F.col(rid).alias("_rid"))


# ---- columns ---------------------------------------------------------------------------------------------------------------

def column_facts(df, columns, per_pass=200):
    """rows, nulls, smallest and largest value per column; very wide tables take several passes."""
    facts = {}
    for i in range(0, len(columns), per_pass):
        part = columns[i:i + per_pass]
        row = df.agg(F.count(F.lit(1)), *[x for c in part for x in (
            F.count(f"`{c}`"), F.min(F.col(f"`{c}`").cast("string")), F.max(F.col(f"`{c}`").cast("string")))]).first()
        for k, c in enumerate(part):
            facts[c] = {"rows": row[0], "filled": row[3 * k + 1], "min": row[3 * k + 2], "max": row[3 * k + 3]}
    return facts


def column_findings(df, rid="_rid", empty_rate=0.95, facts=None):
    """GLOBAL-01 and GLOBAL-02: (rule, column) for nearly empty and for constant columns."""
    cols = [c for c in df.columns if c != rid]
    facts = facts or column_facts(df, cols)
    found = []
    for c in cols:
        f = facts[c]
        if f["rows"] and (f["rows"] - f["filled"]) / f["rows"] > empty_rate:
            found.append(("GLOBAL-01", c))
        if f["filled"] and f["min"] == f["max"]:
            found.append(("GLOBAL-02", c))
    return found


def cell_type(v):
    bare = F.replace(F.trim(v), F.lit(","), F.lit(""))
    return (F.when(bare.rlike(r"^[+-]?\d+$"), "integer").when(number(bare).isNotNull(), "float")
            .when(folded(v).isin("true", "false", "yes", "no"), "boolean").when(F.trim(v).rlike(DATE_LIKE_PATTERN), "date").otherwise("string"))


def type_report(df, rid="_rid"):
    """GLOBAL-09: dominant cell type and % of other cells per column: one pass, a handful of rows per column."""
    cols = [c for c in df.columns if c != rid]
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "cell")
    counts = (long.filter("cell is not null").select("column", cell_type(F.col("cell")).alias("type"))
              .groupBy("column", "type").agg(F.count("*").alias("n")))
    rank = F.struct("n", -F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type")))
    return counts.groupBy("column").agg(
        F.max_by("type", rank).alias("dominant_type"), F.round((F.sum("n") - F.max("n")) / F.sum("n") * 100, 2).alias("mismatch_pct"))


def mixed_columns(report, over=20):
    """GLOBAL-16 (over 20 %); GLOBAL-09 logs at 10 %."""
    return report.filter(F.col("mismatch_pct") > over)


def merged_cell_columns(df, order_cols, rid="_rid", facts=None):
    """GLOBAL-13: columns 20 to 90 % null whose values are two or more rows apart on average."""
    cols = [c for c in df.columns if c not in (rid, *order_cols)]
    facts = facts or column_facts(df, cols)
    likely = [c for c in cols if facts[c]["rows"] >= 4 and 0.2 <= 1 - facts[c]["filled"] / facts[c]["rows"] <= 0.9 and facts[c]["filled"] >= 2]
    if not likely:
        return []
    placed = ordered.numbered(df.select(*order_cols, *likely), order_cols)
    at = placed.agg(*[x for c in likely for x in (F.min(F.when(F.col(f"`{c}`").isNotNull(), F.col("_pos"))),
                                                   F.max(F.when(F.col(f"`{c}`").isNotNull(), F.col("_pos"))))]).first()
    return [c for k, c in enumerate(likely) if (at[2 * k + 1] - at[2 * k]) / (facts[c]["filled"] - 1) >= 2]


def fill_merged_cells(df, order_cols, rid="_rid", facts=None):
    """GLOBAL-13: the chosen columns are filled downwards."""
    chosen = merged_cell_columns(df, order_cols, rid, facts)
    return (ordered.forward_fill(df, order_cols, chosen), chosen) if chosen else (df, [])


def clean_global(df, order_cols=("_rid",), rid="_rid", fill=True):
    """All whole-table rules in order. Returns (table, flags, audit). Without ``fill``, GLOBAL-13 is left for later."""
    spark, header = df.sparkSession, [c for c in df.columns if c != rid]
    cells = apply_rules(df, [cell_rules(c) for c in text_columns(df, rid)], rid)
    kept, dropped = rows_to_drop(cells.table, rid, header)
    named, renamed = with_normal_names(kept, rid)
    cols = [c for c in named.columns if c != rid]
    facts = column_facts(named, cols)
    filled, chosen = fill_merged_cells(named, list(order_cols), rid, facts) if fill else (named, [])
    report = type_report(filled, rid)
    notes = column_findings(filled, rid, facts={**facts, **(column_facts(filled, chosen) if chosen else {})})
    notes += [(f"GLOBAL-10 {level}", c) for c, level in pii_tags(cols)]
    note_frame = spark.createDataFrame([(None, r, c) for r, c in notes], "_rid bigint, rule string, column string")
    mixed = mixed_columns(report).select(F.lit(None).cast("long").alias("_rid"), F.lit("GLOBAL-16").alias("rule"), "column")
    thin = sparse_rows(filled, rid).select(F.col("_rid").cast("long").alias("_rid"), F.lit("GLOBAL-06").alias("rule"), F.lit(None).cast("string").alias("column"))
    names = spark.createDataFrame([(None, "GLOBAL-03", n, o, n) for o, n in renamed.items()] + [(None, "GLOBAL-13", c, None, "filled downwards") for c in chosen],
                                  "_rid bigint, rule string, column string, old_value string, new_value string")
    gone = dropped.select(F.col("_rid").cast("long").alias("_rid"), "rule", F.lit(None).cast("string").alias("column"),
                          F.lit(None).cast("string").alias("old_value"), F.lit("row dropped").alias("new_value"))
    changed = cells.audit.select(F.col(rid).cast("long").alias("_rid"), "rule", "column", "old_value", "new_value")
    return filled, reduce(DataFrame.unionByName, [note_frame, mixed, thin]), reduce(DataFrame.unionByName, [changed, gone, names])
