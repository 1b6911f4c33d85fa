"""Business ratios worked out from whatever columns are there, and period growth."""
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed_values import RATIO_METRICS, STAY_WORDS


def _find(columns, patterns, taken=()):
    """First column whose name contains a pattern; a column serves one side of a ratio only."""
    return next((c for c in columns if c not in taken and any(p in c.lower() for p in patterns)), None)


def plan_metrics(columns):
    """DM-ENGINE: [(metric, numerator column, denominator column, expression)] the columns allow."""
    number = lambda c: F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")
    out = []
    for name, top, bottom, factor in RATIO_METRICS:
        a = _find(columns, top)
        b = _find(columns, bottom, (a,))
        if a and b and name not in columns:
            out.append((name, a, b, F.round(number(a) / F.nullif(number(b), F.lit(0.0)) * factor, 2)))
    a = _find(columns, STAY_WORDS[0])
    b = _find(columns, STAY_WORDS[1], (a,))
    if a and b:
        day = lambda c: F.col(f"`{c}`").cast("string").try_cast("date")
        out.append(("length_of_stay_days", a, b, F.datediff(day(a), day(b))))
    return out


def add_derived_metrics(df, rid="_rid"):
    """DM-ENGINE: the table with every metric that has at least one value; one aggregate decides which stay."""
    found = plan_metrics([c for c in df.columns if c != rid])
    if not found:
        return df
    wide = df.select("*", *[e.alias(n) for n, _, _, e in found])
    filled = wide.agg(*[F.count(n) for n, *_ in found]).first()
    return wide.drop(*[n for k, (n, *_) in enumerate(found) if not filled[k]])


def describe_metrics(df, rid="_rid"):
    """DM-ENGINE: metric, its source columns, and range."""
    found = plan_metrics([c for c in df.columns if c != rid])
    stats = df.agg(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(a).alias("numerator"), F.lit(b).alias("denominator"), F.count(e).alias("n"),
                                      F.min(e.cast("double")).alias("min"), F.max(e.cast("double")).alias("max")) for n, a, b, e in found]).alias("s"))
    return stats.select(F.inline("s")).filter("n > 0")


def growth(df, period_col, value_col, out="change_pct"):
    """DM-YOY, DM-MOM: values are summed per period first; change in % against the period before it."""
    sums = df.filter(F.col(period_col).isNotNull()).groupBy(period_col).agg(F.sum(value_col).alias("value"))
    before = F.lag("value").over(W.orderBy(period_col))
    return sums.select(period_col, "value", before.alias("_b")).select(
        period_col, F.round("value", 2).alias("value"), F.round((F.col("value") - F.col("_b")) / F.nullif(F.col("_b"), F.lit(0.0)) * 100, 2).alias(out))
