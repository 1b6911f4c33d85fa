"""The generic cleaning pass and the quality score."""
import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.dates import parse_date
from ..plans.quantiles import exact_quantiles
from ..plans.profile import column_statistics
from .duplicates import drop_exact
from .rules import value_counts

DATE_TOKENS = {"date", "dob", "day", "month", "created", "updated", "time", "timestamp"}


def _tokens(name):
    return set(re.split(r"[_\W]+", name.lower()))


def lower_names(df, rid="_rid"):
    """PIPE-02."""
    return df.toDF(*[c if c == rid else re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") for c in df.columns])


def null_rates(df, rid="_rid"):
    """PIPE-06: column, null_count, null_pct."""
    cols = [c for c in df.columns if c != rid]
    wide = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("null_count")) for c in cols]).alias("s"))
    return wide.select("n", F.inline("s")).select("column", "null_count", F.round(F.col("null_count") / F.col("n") * 100, 2).alias("null_pct"))


def drop_sparse_columns(df, threshold=0.8, rid="_rid"):
    """PIPE-03."""
    cols = [c for c in df.columns if c != rid]
    row = df.agg(F.count(F.lit(1)), *[F.count(f"`{c}`") for c in cols]).first()
    return df.drop(*[c for i, c in enumerate(cols) if row[0] and 1 - row[i + 1] / row[0] > threshold])


def month_columns(df, rid="_rid", least=0.8):
    """PIPE-04: date-named text columns get ``<c>_month`` ('yyyy-MM'); the column itself stays. Every value is tried, not twenty."""
    texts = [c for c, t in df.dtypes if t == "string" and c != rid and _tokens(c) & DATE_TOKENS]
    if not texts:
        return df
    parsed = df.select("*", *[parse_date(F.col(f"`{c}`")).alias(f"{c}~day") for c in texts])
    row = parsed.agg(*[x for c in texts for x in (F.count(f"`{c}`"), F.count(f"`{c}~day`"))]).first()
    chosen = [c for i, c in enumerate(texts) if row[2 * i] and row[2 * i + 1] >= least * row[2 * i]]
    return parsed.select(*[F.col(f"`{c}`") for c in df.columns], *[F.date_format(f"`{c}~day`", "yyyy-MM").alias(f"{c}_month") for c in chosen])


def age_groups(df, rid="_rid", least=0.9):
    """PIPE-05: numeric columns named age, nearly all within 0 to 120, get ``<c>_group``."""
    ages = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and "age" in _tokens(f.name)]
    if not ages:
        return df
    row = df.agg(*[x for c in ages for x in (F.count(f"`{c}`"), F.count_if(F.col(f"`{c}`").between(0, 120)))]).first()
    chosen = [c for i, c in enumerate(ages) if row[2 * i] and row[2 * i + 1] >= least * row[2 * i]]
    band = lambda v: F.when(v.between(0, 18), "0-18").when(v <= 35, "19-35").when(v <= 60, "36-60").when(v <= 120, "60+")
    return df.select("*", *[F.when(F.col(f"`{c}`") >= 0, band(F.col(f"`{c}`"))).alias(f"{c}_group") for c in chosen])


def fill_number(df, column, method="mean"):
    """PIPE-07: missing numbers become the mean, or the exact median."""
    value = exact_quantiles(df, F.col(f"`{column}`"), [0.5])[0] if method == "median" else df.agg(F.avg(F.col(f"`{column}`").cast("double"))).first()[0]
    return df if value is None else df.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.lit(value)))


def fill_mode(df, column):
    """PIPE-08: missing values become the most frequent value (ties: the smallest)."""
    top = value_counts(df, column).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v")).first()[0]
    return df if top is None else df.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.lit(top)))


def outliers(df, column, rid="_rid", reach=1.5):
    """PIPE-09: rows outside the interquartile fences, with the fences; needs four values."""
    v = F.col(f"`{column}`").cast("double")
    if df.filter(v.isNotNull()).limit(4).count() < 4:
        return df.select(F.col(rid).alias("_rid"), v.alias("value"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high")).filter("false")
    q1, q3 = exact_quantiles(df, v, [0.25, 0.75])
    low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    return df.filter((v < low) | (v > high)).select(F.col(rid).alias("_rid"), v.alias("value"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def basic_clean(df, rid="_rid", sparse=0.8):
    """PIPE-01 to PIPE-08 in order; numbers are filled with the mean, text with the most frequent value."""
    return basic_clean_audited(df, rid, sparse)[0]


def basic_clean_audited(df, rid="_rid", sparse=0.8):
    """The table of ``basic_clean``, and one line per filled cell: rule, column, _rid, old_value (null), new_value."""
    out = age_groups(month_columns(drop_sparse_columns(lower_names(drop_exact(df, rid), rid), sparse, rid), rid), rid)
    numbers = [f.name for f in out.schema.fields if isinstance(f.dataType, NumericType) and f.name != rid]
    texts = [c for c, t in out.dtypes if t == "string" and c != rid]
    facts = out.agg(F.count(F.lit(1)), *[F.avg(F.col(f"`{c}`").cast("double")) for c in numbers], *[F.count_if(F.col(f"`{c}`").isNull()) for c in texts]).first()
    means = facts[1:1 + len(numbers)]
    # only columns with gaps need their most frequent value, which costs a shuffle of their distinct values
    texts = [c for c, gaps in zip(texts, facts[1 + len(numbers):]) if gaps]
    tops = {}
    if texts:
        long = out.select(*[F.col(f"`{c}`") for c in texts]).unpivot([], texts, "column", "value").filter("value is not null")
        counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
        tops = {r["column"]: r["v"] for r in counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("v")).collect()}
    fills = {**{c: m for c, m in zip(numbers, means) if m is not None}, **tops}
    filled = out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(fills[c])).alias(c) if c in fills else F.col(f"`{c}`") for c in out.columns])
    lines = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.struct(F.lit("PIPE-07" if c in numbers else "PIPE-08").alias("rule"), F.lit(c).alias("column"), F.lit(str(v)).alias("new_value"))) for c, v in fills.items()]))
    if not fills:
        return filled, df.sparkSession.createDataFrame([], "rule string, column string, _rid bigint, old_value string, new_value string")
    audit = out.select(F.col(rid).alias("_rid"), F.inline(lines)).select("rule", "column", "_rid", F.lit(None).cast("string").alias("old_value"), "new_value")
    return filled, audit


def quality_score(df, original_rows, rid="_rid", legacy=False):
    """QUAL-01: 0.4 completeness + 0.3 uniqueness + 0.2 consistency + 0.1 integrity.

    A column is consistent when at least 95 % of its values are numbers, or at least 95 % are not. ``legacy`` counts every
    column as consistent.
    """
    cols = [c for c in df.columns if c != rid]
    row = df.agg(F.count(F.lit(1)), *[x for c in cols for x in (F.count(f"`{c}`"), F.count(F.trim(F.col(f"`{c}`").cast("string")).try_cast("double")))]).first()
    rows = row[0]
    filled, numeric = row[1::2], row[2::2]
    cells = rows * len(cols)
    complete = sum(filled) / cells * 100 if cells else 100.0
    unique = min(rows / original_rows * 100, 100.0) if original_rows else 0.0
    even = sum(f == 0 or n / f >= 0.95 or n / f <= 0.05 for f, n in zip(filled, numeric))
    consistent = 100.0 if legacy else even / len(cols) * 100
    score = 0.4 * complete + 0.3 * unique + 0.2 * consistent + 0.1 * complete
    return df.sparkSession.createDataFrame([(round(complete, 2), round(unique, 2), round(consistent, 2), round(complete, 2), round(min(max(score, 0.0), 100.0), 2))],
                                           "completeness double, uniqueness double, consistency double, integrity double, score double")
