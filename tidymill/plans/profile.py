"""Column profile, semantic types and column roles.

Everything a decision needs is an aggregate over the whole column, gathered for many columns in one pass. What reaches
the driver is one row of numbers per pass; the decisions themselves are made on those numbers.
"""
import re

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..functions.fixed_values import CODE_NAME_WORDS, DATE_NAME_WORDS, ID_NAME_PATTERNS, PATTERNS, TEMPORAL, TYPES
from ..functions.text import number as as_number
from . import ordered


#: Columns of one pass. Up to 128 keys are aggregated in a map in memory; with more, Spark sorts all cells of a task.
PER_PASS = 100


def column_statistics(df, columns=None, rid="_rid", samples=0):
    """{column: numbers}: counts, pattern shares, numeric share, range, integrality, distinct values (estimated), text length, ``samples`` values.

    The cells are unpivoted inside the scan stage and aggregated by column name. The plan does not grow with the number
    of columns, partial aggregation leaves one row per column and task, and one row per column reaches the driver. The
    sketch of distinct values makes Spark keep the buffers, which hold texts, as objects in a map: a task holds one buffer
    per column and never sorts its cells. Very wide tables take several passes.
    """
    columns = [c for c in (columns or df.columns) if c != rid]
    found = {}
    for i in range(0, len(columns), PER_PASS):
        found.update(_column_statistics(df, columns[i:i + PER_PASS], samples))
    nothing = {f: 0 for f in (*[s for s, _, _ in PATTERNS], *[f"t_{s}" for s, _ in TEMPORAL], "rows", "filled", "numeric", "decimals", "distinct", "years")}
    return {c: found.get(c, {**nothing, "min": None, "max": None, "avg_length": None, "low": None, "high": None, **{f"s{k}": None for k in range(samples)}}) for c in columns}


def _column_statistics(df, columns, samples):
    cells = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "cell")
    cells = cells.select("column", "cell", F.trim("cell").alias("t")).select("*", as_number(F.col("t")).alias("x"))
    t, x = F.col("t"), F.col("x")
    # Values with the least hash under one salt after another: the same ones however the rows are dealt, and few per column.
    least = [F.min(F.when(F.col("cell").isNotNull(), F.struct(F.xxhash64("cell", F.lit(k)).alias("h"), F.col("cell").alias("value")))).alias(f"s{k}") for k in range(samples)]
    rows = cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count(t).alias("filled"), F.count(x).alias("numeric"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.count_if(x != F.floor(x)).alias("decimals"), F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(t, F.lit(14))), F.lit(0)).alias("distinct"), F.avg(F.length(t)).alias("avg_length"),
        F.min(t).alias("low"), F.max(t).alias("high"), F.count_if(x.between(1900, 2100) & (x == F.floor(x))).alias("years"),
        *[F.count_if(t.rlike(p)).alias(s) for s, p, _ in PATTERNS], *[F.count_if(t.rlike(p)).alias(f"t_{s}") for s, p in TEMPORAL], *least).collect()
    return {r["column"]: r.asDict() for r in rows}


def profile_columns(df, columns=None, rid="_rid", samples=3):
    """SRC-06: column, dtype, rows, nulls, distinct values (estimated), share of numbers, three sample values."""
    columns = [c for c in (columns or df.columns) if c != rid]
    stats, types = column_statistics(df, columns, rid, samples), dict(df.dtypes)
    shown = {c: list(dict.fromkeys(v["value"] for v in (stats[c][f"s{k}"] for k in range(samples)) if v)) for c in columns}
    rows = [(c, types[c], s["rows"], s["rows"] - s["filled"], s["distinct"], round(s["numeric"] / s["filled"], 4) if s["filled"] else 0.0, shown[c])
            for c, s in ((c, stats[c]) for c in columns)]
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, rows bigint, null_count bigint, distinct_count bigint, numeric_share double, samples array<string>")


def distinct_counts(df, columns):
    """Exact distinct non-null values per column: one shuffle of (column, value), combined on the map side first."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return (long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
            .groupBy("column").agg(F.count("*").alias("distinct_count"), F.sum("n").alias("filled")))


# ---- semantic types ----------------------------------------------------------------------------------------------------

def match_name(column):
    """HTYPE-NAME: (set, confidence, reason). A whole name scores 1.0, a term inside it 0.85, a prefix 0.75."""
    name = re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s\-.]+", "_", column.lower().strip()))
    padded = f"_{name}_"
    best = None
    for kind, t in TYPES.items():
        for term in t["terms"]:
            if name == term:
                return kind, 1.0, f"name is '{term}'"
            if not term.endswith("_") and f"_{term}_" in padded and (best is None or len(term) > best[0]):
                best = (len(term), kind, 0.85, f"name contains '{term}'")
    if best:
        return best[1:]
    for kind, t in TYPES.items():
        for term in t["terms"]:
            if term.endswith("_") and name.startswith(term):
                return kind, 0.75, f"name starts with '{term}'"
    return None


def match_pattern(s):
    """HTYPE-PATTERN, HTYPE-TEMPORAL."""
    if not s["filled"]:
        return None
    for kind, _, least in PATTERNS:
        share = s[kind] / s["filled"]
        if share >= least:
            return kind, round(0.6 + (share - least) * 0.4, 4), "value pattern"
    for kind, _ in TEMPORAL:
        if s[f"t_{kind}"] / s["filled"] >= 0.5:
            return kind, 0.7, "temporal value pattern"
    return None


def match_distribution(column, s):
    """HTYPE-DIST."""
    n, name = s["filled"], column.lower()
    if not n:
        return None
    tokens = set(name.split("_"))
    if s["numeric"] / n >= 0.9:
        decimal = s["decimals"] / s["numeric"]
        if 0 <= s["min"] and s["max"] <= 150 and decimal < 0.1 and tokens & {"age", "years"}:
            return "AGE", 0.6, "integers 0 to 150"
        if 0 <= s["min"] and s["max"] <= 100 and any(w in name for w in ("percent", "rate", "ratio")):
            return "PCT", 0.6, "numbers 0 to 100"
        if s["distinct"] <= 11 and 0 <= s["min"] and s["max"] <= 10:
            return "SCORE", 0.5, "few values 0 to 10"
        if s["min"] >= 1 and s["max"] <= 2 * n and decimal < 0.05:
            return "RANK", 0.4, "positive integers"
        if s["min"] >= 0 and decimal < 0.1:
            return "QTY", 0.4, "non-negative integers"
        return "AMT", 0.35, "numbers"
    if s["distinct"] <= 10 and s["distinct"] / n < 0.1:
        return ("STAT", 0.5, "few values") if "status" in name or "state" in tokens else ("CAT", 0.45, "few values")
    return ("TEXT", 0.4, "long text") if (s["avg_length"] or 0) > 50 else None


def decide_type(column, s):
    """HTYPE-COLUMN: name (0.75 and up), value pattern (0.6 and up), distribution, weak name, text."""
    by_name, by_pattern = match_name(column), match_pattern(s)
    if by_name and by_name[1] >= 0.75:
        return by_name
    if by_pattern and by_pattern[1] >= 0.6:
        return by_pattern
    return match_distribution(column, s) or by_name or ("TEXT", 0.2, "no type found")


TYPE_SCHEMA = "column string, htype string, formula_set string, confidence double, reason string, is_pii boolean, sensitivity string"


def semantic_types(df, columns=None, rid="_rid", stats=None):
    """One row per column. Also usable as {column: formula set} through ``type_map``."""
    columns = [c for c in (columns or df.columns) if c != rid]
    stats = stats or column_statistics(df, columns, rid)
    rows = []
    for c in columns:
        kind, confidence, reason = decide_type(c, stats[c])
        t = TYPES[kind]
        rows.append((c, t["code"], kind, float(confidence), reason, t["is_pii"], t["sensitivity"]))
    return df.sparkSession.createDataFrame(rows, TYPE_SCHEMA)


def type_map(types):
    return {r["column"]: r["formula_set"] for r in types.collect()}


def type_report(types):
    """HTYPE-REPORT: columns and confidence per type, and how many hold personal or highly sensitive data."""
    return types.groupBy("formula_set").agg(
        F.count("*").alias("n_columns"), F.round(F.min("confidence"), 4).alias("min_confidence"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.count_if("is_pii").alias("n_pii"), F.count_if(F.col("sensitivity") == "high").alias("n_high"))


def merge_types(detected, external, accept=0.85, weak=0.6):
    """HTYPE-MERGE: an outside classification (column, formula_set, confidence) wins when sure, or when both agree."""
    e = external.select("column", F.col("formula_set").alias("e_set"), F.col("confidence").alias("e_conf"))
    d = detected.select("column", F.col("formula_set").alias("d_set"), F.col("confidence").alias("d_conf"))
    j = d.join(e, "column", "full_outer")
    sure, agree = F.col("e_conf") >= accept, F.col("e_set") == F.col("d_set")
    medium = F.col("e_conf").between(weak, accept)
    return j.select(
        "column", F.when(sure | F.col("d_set").isNull(), F.col("e_set")).otherwise(F.col("d_set")).alias("formula_set"),
        F.when(sure | F.col("d_set").isNull() | (medium & agree), F.col("e_conf")).otherwise(F.col("d_conf")).alias("confidence"),
        F.when(F.col("e_set").isNull(), "detected").when(sure, "external").when(medium & agree, "agreed").when(medium, "conflict").otherwise("low_confidence").alias("decision"))


# ---- roles -----------------------------------------------------------------------------------------------------------------

_ID_NAME = re.compile("|".join(ID_NAME_PATTERNS))


def sequences(df, columns, order_cols, stats=None):
    """ROLE-01: columns that rise in even steps along the row order. Previous values come across range borders."""
    if not columns:
        return []
    # even steps mean that no value repeats: check that first, it needs no ordering
    s = stats or column_statistics(df, columns)
    likely = [c for c in columns if s[c]["numeric"] == s[c]["filled"] > 10 and s[c]["max"] > s[c]["min"] and s[c]["distinct"] > 0.9 * s[c]["filled"]]
    if not likely:
        return []
    numbers = df.select(*order_cols, *[F.col(f"`{c}`").cast("double").alias(f"v_{c}") for c in likely if c not in order_cols],
                        *[F.col(f"`{c}`").cast("double").alias(f"v_{c}") for c in likely if c in order_cols])
    paired = ordered.neighbours(numbers, order_cols, [f"v_{c}" for c in likely], following=False)
    step = {c: F.col(f"`v_{c}`") - F.col(f"`v_{c}_prev`") for c in likely}
    row = paired.agg(*[x for c in likely for x in (F.min(step[c]), F.coalesce(F.stddev_samp(step[c]), F.lit(0.0)))]).first()
    return [c for k, c in enumerate(likely) if row[2 * k] is not None and row[2 * k] >= 0 and row[2 * k + 1] < 0.01]


def column_roles(df, columns=None, order_cols=("_rid",), rid="_rid", stats=None):
    """ROLE-01: constant, boolean, sequence, identifier, code, date, metric, text or category."""
    columns = [c for c in (columns or df.columns) if c != rid]
    stats = stats or column_statistics(df, columns, rid)
    types = dict(df.dtypes)
    in_sequence = set(sequences(df, [c for c in columns if stats[c]["numeric"] == stats[c]["filled"] > 10], list(order_cols), stats))
    rows = []
    for c in columns:
        s, low = stats[c], c.lower().replace(" ", "_").replace("-", "_")
        n, d = s["filled"], s["distinct"]
        unique = d / n if n else 0
        temporal = types[c].startswith(("date", "timestamp")) or (n and (s["t_DATE"] + s["t_DTM"]) / n > 0.7)
        if not n or s["low"] == s["high"]:
            role = "constant"
        elif d == 2:
            role = "boolean"
        elif c in in_sequence:
            role = "sequence"
        elif _ID_NAME.search(low) and unique > 0.7:
            role = "identifier"
        elif "code" in low or any(w in low.split("_") for w in CODE_NAME_WORDS):
            role = "code"
        elif temporal or (any(w in low for w in DATE_NAME_WORDS) and s["years"] == n and d <= 50):
            role = "date"
        elif s["numeric"] / n > 0.85:
            role = "identifier" if unique > 0.9 and d > 100 and s["decimals"] == 0 else "metric"
        else:
            role = "category" if d <= 50 else "text"
        rows.append((c, role, int(d), int(n)))
    return df.sparkSession.createDataFrame(rows, "column string, role string, distinct_count bigint, filled bigint")


def plottable(roles, code_limit=30):
    """ROLE-02: which columns may be an x axis or a y axis."""
    few_codes = (F.col("role") == "code") & (F.col("distinct_count") <= code_limit)
    return roles.filter(~F.col("role").isin("identifier", "sequence", "constant")).select(
        "column", "role", (F.col("role").isin("category", "boolean", "date") | few_codes).alias("x_axis"), (F.col("role") == "metric").alias("y_axis"))


def column_kinds(roles):
    """ROLE-03: chart kind of a column: date, numeric, boolean, id, or a category by its number of values."""
    d = F.col("distinct_count")
    return roles.select("column", F.when(F.col("role") == "date", "date").when(F.col("role") == "metric", "numeric").when(F.col("role") == "boolean", "boolean")
                        .when(F.col("role").isin("identifier", "sequence"), "id").when(d <= 6, "category_tiny").when(d <= 15, "category_small")
                        .when(d <= 50, "category_medium").otherwise("category_large").alias("kind"))


def relevance(roles, rows):
    """ROLE-04: keep or drop a column, with the reason; over 30 % missing is a warning."""
    missing = 1 - F.col("filled") / F.lit(rows)
    drop = F.col("role").isin("identifier", "constant", "sequence") | (F.col("filled") == 0)
    return roles.select("column", F.when(drop, "drop").otherwise("keep").alias("decision"),
                        F.when(F.col("filled") == 0, "empty").when(drop, F.col("role")).when(missing > 0.3, "many missing values").otherwise("useful").alias("reason"))


def dataset_shape(df, category_col, time_col):
    """ROLE-05: longitudinal when some category value is seen at two or more times."""
    spans = df.groupBy(category_col).agg(F.min(time_col).alias("a"), F.max(time_col).alias("b"))
    return spans.agg(F.when(F.max(F.col("a") != F.col("b")), "longitudinal").otherwise("cross_sectional").alias("shape"))


#: Whole words of a column name that tell a time (a fixed value).
TIME_WORDS = ("year", "date", "time", "month", "quarter", "period", "fiscal", "semester", "week", "day")


def time_columns(df, rid="_rid"):
    """Columns of dates and times, those whose name holds a word for one, and those of which all numbers are years from 1800 to 2100."""
    columns = [f for f in df.schema.fields if f.name != rid]
    sure = {f.name for f in columns if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)) or set(re.split(r"[_\W]+", f.name.lower())) & set(TIME_WORDS)}
    asked = [f.name for f in columns if f.name not in sure]
    if asked:
        number = lambda c: F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")
        row = df.agg(*[x for c in asked for x in (F.min(number(c)), F.max(number(c)))]).first()
        sure |= {c for i, c in enumerate(asked) if row[2 * i] is not None and row[2 * i] >= 1800 and row[2 * i + 1] <= 2100}
    return [c for c in df.columns if c in sure]


def entity_columns(df, rid="_rid", most=100):
    """Text columns with at least two and at most ``most`` different values, and no more than half as many as there are rows."""
    texts = [c for c, t in df.dtypes if t == "string" and c != rid]
    if not texts:
        return []
    values = df.select(*[F.col(f"`{c}`") for c in texts]).unpivot([], texts, "column", "value")
    counts = {r["column"]: r["n"] for r in values.filter("value IS NOT NULL").distinct().groupBy("column").agg(F.count("*").alias("n")).collect()}
    rows = df.count()
    return [c for c in texts if 2 <= counts.get(c, 0) <= min(most, rows * 0.5)]


def detect_dataset_shape(df, rid="_rid"):
    """ROLE-05: (dataset_type, time_col, entity_col): longitudinal if an entity is seen at two or more times, cross_sectional with a time column, else flat. One aggregate per entity column."""
    times, made = time_columns(df, rid), "dataset_type string, time_col string, entity_col string"
    for entity in entity_columns(df, rid) if times else ():
        if entity in times:
            continue
        spans = df.filter(F.col(f"`{entity}`").isNotNull()).groupBy(f"`{entity}`").agg(*[(F.min(f"`{c}`") != F.max(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(times)])
        moved = spans.agg(*[F.bool_or(f"t{i}") for i in range(len(times))]).first()
        if any(moved):
            return df.sparkSession.createDataFrame([("longitudinal", next(c for c, m in zip(times, moved) if m), entity)], made)
    return df.sparkSession.createDataFrame([("cross_sectional", times[0], None) if times else ("flat", None, None)], made)
