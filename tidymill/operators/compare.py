"""Comparison of two datasets: matched columns and the change of their totals."""
from functools import reduce

from pyspark.sql import functions as F


def name_likeness(a, b):
    """0 to 100: twice the longest common subsequence over the summed length, of the lower-case names."""
    a, b = a.lower(), b.lower()
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def match_columns(left, right, threshold=75):
    """CMP-01: {left column: right column}, each left column in turn taking the best free partner."""
    free, out = list(right), {}
    for a in left:
        best = max(free, key=lambda b: (name_likeness(a, b), -free.index(b)), default=None)
        if best is not None and name_likeness(a, best) >= threshold:
            out[a] = best
            free.remove(best)
    return out


def align(df1, df2, mapping):
    """CMP-02: both tables with the matched columns only, under the names of the first."""
    pairs = [(a, b) for a, b in mapping.items() if a in df1.columns and b in df2.columns]
    return df1.select(*[F.col(f"`{a}`") for a, _ in pairs]), df2.select(*[F.col(f"`{b}`").alias(a) for a, b in pairs])


def _totals(df, columns, name):
    n = lambda c: F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")
    return df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.sum(n(c)).alias(name)) for c in columns]).alias("s")).select(F.inline("s"))


def deltas(df1, df2, mapping=None):
    """CMP-03: totals per matched numeric column and their % change; null when the first total is 0. One aggregate per side."""
    a, b = align(df1, df2, mapping or match_columns(df1.columns, df2.columns))
    t1, t2 = F.col("period1_value"), F.col("period2_value")
    both = _totals(a, a.columns, "period1_value").join(_totals(b, b.columns, "period2_value"), "column").filter(t1.isNotNull() & t2.isNotNull())
    return both.select("column", F.round(t1, 2).alias("period1_value"), F.round(t2, 2).alias("period2_value"),
                       F.round((t2 - t1) / F.nullif(F.abs(t1), F.lit(0.0)) * 100, 2).alias("change_pct"))


def significant(changes, threshold=20):
    """CMP-04."""
    return changes.filter(F.abs("change_pct") >= threshold)
