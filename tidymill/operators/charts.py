"""Plot points: small result tables for time series, distributions, grouped series, rankings, scatters and correlations."""
from pyspark.sql import functions as F

from .analytics import period_label, period_start

# longest span in days and the bucket used up to it
SPANS = ((1, "hour"), (31, "day"), (90, "week"), (1825, "month"), (3650, "quarter"))


def time_unit(df, date_col):
    """CH-02."""
    span = df.agg(F.datediff(F.max(F.col(date_col).cast("date")), F.min(F.col(date_col).cast("date")))).first()[0]
    if span is None:
        return "month"
    return next((u for days, u in SPANS if span <= days), "year")


def _bucket(date_col, unit):
    if unit == "hour":
        return F.date_format(F.col(date_col), "yyyy-MM-dd HH:00")
    return period_label(period_start(F.col(date_col), unit), unit)


def _agg(y, how):
    v = F.col(f"`{y}`").cast("double") if y else None
    return {"sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "count": lambda: F.count(F.lit(1))}[how if y else "count"]()


def time_series(df, date_col, y=None, agg="sum", group_by=None, unit=None):
    """CH-03: x (label), optional group, y. The bucket follows the span of the dates."""
    unit = unit or time_unit(df, date_col)
    keys = [_bucket(date_col, unit).alias("x"), *([F.col(group_by).cast("string").alias("group")] if group_by else [])]
    return df.filter(F.col(date_col).isNotNull()).groupBy(*keys).agg(F.round(_agg(y, agg), 4).alias("y")).orderBy("x")


def distribution(df, x, k=20):
    """CH-04: the k most frequent values."""
    return (df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("name")).agg(F.count("*").alias("value"))
            .orderBy(F.desc("value"), "name").limit(k))


def grouped_series(df, x, y, group_by, k=10):
    """CH-05: mean y per x for the k groups with the largest sum of y, one column per group."""
    v = F.col(f"`{y}`").cast("double")
    top = [r[0] for r in df.filter(F.col(group_by).isNotNull()).groupBy(F.col(group_by).cast("string").alias("g")).agg(F.sum(v).alias("s")).orderBy(F.desc("s"), "g").limit(k).collect()]
    kept = df.filter(F.col(group_by).cast("string").isin(*top))
    return (kept.groupBy(F.col(x).cast("string").alias("x")).pivot(group_by, top).agg(F.round(F.avg(v), 4)).orderBy("x"))


def scatter(df, x, y, key="_rid", points=400, seed=42):
    """CH-06: up to 400 pairs. A hash of the row key decides, so the sample does not depend on partitions."""
    a, b = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    pairs = df.filter(a.isNotNull() & b.isNotNull())
    return pairs.select(F.col(key).alias("_rid"), F.round(a, 4).alias("x"), F.round(b, 4).alias("y")).orderBy(F.xxhash64(F.col("_rid"), F.lit(seed)), "_rid").limit(points)


def line(df, x, y):
    """CH-07: mean y per x, in order of x."""
    return df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(F.round(F.avg(F.col(f"`{y}`").cast("double")), 4).alias("y")).filter("y is not null").orderBy("x")


def ranked_bar(df, x, y, k=30):
    """CH-08: the k largest sums of y per x; ``k=None`` is the plain bar."""
    sums = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("x")).agg(F.sum(F.col(f"`{y}`").cast("double")).alias("s"))
    shown = sums.orderBy(F.desc("s"), "x").limit(k) if k else sums
    return shown.select("x", F.round("s", 4).alias("y"))


def suite_specs(roles, derived=(), limit=15):
    """CH-12: up to fifteen (chart, x, y) from the role table (column, role, distinct_count), without repeats."""
    rows = [r.asDict() for r in roles.collect()]
    pick = lambda *rs: [r["column"] for r in rows if r["role"] in rs]
    few = {r["column"]: r["distinct_count"] for r in rows}
    dates, metrics, cats = pick("date"), pick("metric") + list(derived), [c for c in pick("category", "boolean") + [c for c in pick("code") if few[c] <= 30]]
    specs = [("line", d, m) for d in dates[:1] for m in metrics]
    specs += [("bar" if few[c] <= 7 else "ranked_bar", c, m) for c in cats if few[c] <= 50 for m in metrics]
    specs += [("distribution", c, None) for c in cats]
    specs += [("scatter", a, b) for i, a in enumerate(metrics) for b in metrics[i + 1:]]
    return list(dict.fromkeys(specs))[:limit]


def suite(df, roles, derived=(), key="_rid"):
    """CH-12: {(chart, x, y): points}. Charts that share x are cut from one aggregate of all their metrics."""
    specs = suite_specs(roles, derived)
    bars = {}
    for kind, x, y in specs:
        if kind in ("bar", "ranked_bar"):
            bars.setdefault(x, []).append(y)
    shared = {x: df.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("string").alias("x")).agg(
        *[F.sum(F.col(f"`{y}`").cast("double")).alias(f"s_{y}") for y in ys]) for x, ys in bars.items()}
    out = {}
    for kind, x, y in specs:
        if kind == "line":
            out[kind, x, y] = time_series(df, x, y, "mean")
        elif kind in ("bar", "ranked_bar"):
            sums = shared[x].select("x", F.round(f"s_{y}", 4).alias("y"))
            out[kind, x, y] = sums if kind == "bar" else sums.orderBy(F.desc("y"), "x").limit(30)
        elif kind == "distribution":
            out[kind, x, y] = distribution(df, x)
        else:
            out[kind, x, y] = scatter(df, x, y, key)
    return out
