"""Trend, cohort, Pareto, distribution, correlation and forecast results.

Period functions first reduce the table to one row per period; windows over that series are small by construction.
Row-level ordered results (running total, moving average, rank) go through ``plans.ordered``.
"""
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..plans import ordered
from ..plans.facts import attach
from ..plans.quantiles import exact_quantiles, exact_quantiles_of

UNITS = ("day", "week", "month", "quarter", "year")


def period_start(date, unit):
    d = date.cast("date")
    return d if unit == "day" else F.trunc(d, unit)


def period_label(start, unit):
    if unit == "year":
        return F.date_format(start, "yyyy")
    if unit == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.date_format(start, "yyyy-MM" if unit == "month" else "yyyy-MM-dd")


def time_series(df, date_col, value_col, unit="month", agg="sum"):
    """One row per period that occurs: period (date), value."""
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count}[agg]
    return (df.filter(F.col(date_col).isNotNull()).groupBy(period_start(F.col(date_col), unit).alias("period"))
            .agg(fn(value_col).alias("value")))


def period_change(df, date_col, value_col, unit):
    """AN-01, AN-02, AN-03: change in % against the previous period that occurs; a previous value of 0 is skipped."""
    w = W.orderBy("period")
    series = time_series(df, date_col, value_col, unit)
    step = series.select("period", "value", F.lag("period").over(w).alias("before"), F.lag("value").over(w).alias("previous"))
    return (step.filter("previous is not null and previous <> 0")
            .select(period_label(F.col("before"), unit).alias("from_period"),
                    period_label(F.col("period"), unit).alias("to_period"),
                    F.round("previous", 2).alias("previous_value"), F.round("value", 2).alias("current_value"),
                    F.round((F.col("value") - F.col("previous")) / F.col("previous") * 100, 2).alias("change_pct")))


def moving_average(df, order_cols, value_col, n=3, out="moving_average"):
    """AN-04."""
    return ordered.moving_average(df, order_cols, value_col, n, out)


def cumulative_sum(df, order_cols, value_col, out="running_total"):
    """AN-05."""
    return ordered.running_total(df, order_cols, value_col, out)


def cohorts(df, date_col, id_col, unit="year"):
    """AN-06: the first period of every id."""
    return (df.filter(F.col(date_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(id_col)).agg(F.min(F.col(date_col)).alias("_first"))
            .select(id_col, period_label(period_start(F.col("_first"), unit), unit).alias("cohort")))


def cohort_retention(df, date_col, id_col, periods=6):
    """AN-07: % of each monthly cohort active again in the following months, one column per month."""
    month = F.trunc(F.col(date_col).cast("date"), "month")
    active = df.filter(F.col(id_col).isNotNull() & F.col(date_col).isNotNull()).select(F.col(id_col).alias("id"), month.alias("m")).distinct()
    first = active.groupBy("id").agg(F.min("m").alias("cohort"))
    # (id, month) is already distinct, so counting rows counts ids
    age = F.months_between("m", "cohort").cast("int")
    counted = (active.join(first, "id").select("cohort", age.alias("age")).filter(F.col("age") <= periods)
               .groupBy("cohort").agg(*[F.count_if(F.col("age") == p).alias(f"n{p}") for p in range(periods + 1)]))
    return counted.select(
        F.date_format("cohort", "yyyy-MM").alias("cohort"), F.col("n0").alias("cohort_size"),
        *[F.round(F.col(f"n{p}") / F.col("n0") * 100, 2).alias(f"period_{p}") for p in range(periods + 1)])


def pareto(df, category_col, value_col):
    """AN-08: share and cumulative share per category, largest first, and whether it belongs to the top 20 %."""
    totals = (df.filter(F.col(category_col).isNotNull()).groupBy(F.col(category_col).alias("category"))
              .agg(F.sum(value_col).alias("value")).withColumn("_key", -F.col("value")))
    totals = totals.persist()
    whole = totals.agg(F.sum("value").alias("total"), F.count("*").alias("n")).first()
    placed = ordered.running_total(ordered.numbered(totals, ["_key", "category"], "_pos"), ["_key", "category"], "value", "_run")
    if not whole["total"]:
        return placed.filter("false").select("category", "value", F.lit(0.0).alias("percentage"),
                                             F.lit(0.0).alias("cumulative_pct"), F.lit(False).alias("in_top_20_pct"))
    return placed.select("category", F.round("value", 2).alias("value"),
                         F.round(F.col("value") / whole["total"] * 100, 2).alias("percentage"),
                         F.round(F.col("_run") / whole["total"] * 100, 2).alias("cumulative_pct"),
                         (F.col("_pos") < 0.2 * whole["n"]).alias("in_top_20_pct"))


def pareto_top_share(table):
    """AN-08: combined share of the top 20 % of categories."""
    return table.filter("in_top_20_pct").agg(F.round(F.max("cumulative_pct"), 2).alias("top_20_pct_contribution"))


def indexed(series):
    """Add the 0-based position of each period."""
    return series.withColumn("i", F.row_number().over(W.orderBy("period")) - 1)


def seasonality(series, lags=(("weekly", 7), ("monthly", 12), ("quarterly", 4))):
    """AN-09: autocorrelation at three lags; the strongest above 0.5 names the season. Needs 12 points."""
    w = W.orderBy("i")
    base = indexed(series)
    moments = base.agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"), F.count("*").alias("n"))
    shifted = base.select("value", *[F.lead("value", lag).over(w).alias(f"v{lag}") for _, lag in lags])
    shifted = attach(shifted, moments)
    auto = [
        F.when((F.max("n") >= 2 * lag) & (F.max("n") >= 12) & (F.max("var") > 0),
               F.sum((F.col("value") - F.col("mean")) * (F.col(f"v{lag}") - F.col("mean"))) / ((F.max("n") - lag) * F.max("var")))
        .alias(name) for name, lag in lags]
    found = shifted.agg(*auto)
    strength = F.greatest(*[F.coalesce(F.abs(n), F.lit(0.0)) for n, _ in lags])
    best = reduce(lambda acc, n: acc.when((F.abs(n) == strength) & (strength > 0.5), F.lit(n)), [n for n, _ in lags],
                  F.when(F.lit(False), F.lit(None).cast("string")))
    return found.select(F.coalesce(best, F.lit("none")).alias("seasonality"),
                        *[F.round(n, 3).alias(f"autocorrelation_{n}") for n, _ in lags])


def turning_points(series):
    """AN-09: periods higher (peak) or lower (trough) than both neighbours."""
    w = W.orderBy("period")
    near = series.select("period", "value", F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"))
    kind = (F.when((F.col("value") > F.col("a")) & (F.col("value") > F.col("b")), "peak")
            .when((F.col("value") < F.col("a")) & (F.col("value") < F.col("b")), "trough"))
    return near.select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 2).alias("value"),
                       kind.alias("kind")).filter("kind is not null")


def _line(series):
    """Least-squares line of value over position: one row (slope, intercept, r2, mean, n)."""
    return indexed(series).agg(F.regr_slope("value", "i").alias("slope"), F.regr_intercept("value", "i").alias("intercept"),
                               F.coalesce(F.regr_r2("value", "i"), F.lit(0.0)).alias("r2"), F.avg("value").alias("mean"),
                               F.count("*").alias("n"))


def trend(series):
    """AN-10: direction, slope, R2 and confidence."""
    flat = F.col("slope").isNull() | (F.abs("slope") < 0.01 * F.col("mean"))
    return _line(series).select(
        F.when(flat, "FLAT").when(F.col("slope") > 0, "UP").otherwise("DOWN").alias("direction"),
        F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r_squared"),
        F.when(F.col("r2") >= 0.8, "HIGH").when(F.col("r2") >= 0.5, "MEDIUM").otherwise("LOW").alias("confidence"))


def outlier_periods(series):
    """AN-11: periods whose distance from the trend line exceeds two standard deviations of such distances."""
    fitted = attach(indexed(series), _line(series).select("slope", "intercept", "n"))
    gap = fitted.select("period", "i", "value", "n", (F.col("slope") * F.col("i") + F.col("intercept")).alias("fit"))
    gap = gap.withColumn("resid", F.col("value") - F.col("fit"))
    spread = gap.agg(F.stddev_samp("resid").alias("sd"))
    return (attach(gap, spread).filter((F.col("n") >= 3) & (F.col("sd") > 0) & (F.abs("resid") > 2 * F.col("sd")))
            .select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 2).alias("actual"),
                    F.round("fit", 2).alias("predicted"), F.round("resid", 2).alias("deviation"),
                    F.round(F.col("resid") / F.col("sd"), 2).alias("std_devs")))


def rank_within(df, group_col, value_col, ascending=False):
    """AN-12."""
    return ordered.rank_within(df, group_col, value_col, f"{value_col}_rank", ascending)


def percentiles(df, value_cols, probs=(0.25, 0.5, 0.75, 0.9)):
    """AN-13: one row per column."""
    found = exact_quantiles_of(df, {c: F.col(c) for c in value_cols}, list(probs))
    rows = [(c, *found[c]) for c in value_cols]
    names = [f"p{int(p * 100)}" for p in probs]
    made = df.sparkSession.createDataFrame(rows, "column string, " + ", ".join(f"{n} double" for n in names))
    return made.select("column", *[F.round(n, 2).alias(n) for n in names])


def distribution(df, value_col):
    """AN-14: moments with sample corrections; mode is null when every value is different."""
    # Counts are multiplied as doubles: three of them overflow a long from 2.1 million rows on.
    v, n = F.col(value_col).cast("double"), F.col("n").cast("double")
    base = df.filter(v.isNotNull() & ~F.isnan(v))
    counts = base.groupBy(v.alias("v")).agg(F.count("*").alias("c"))
    top = counts.agg(F.max("c").alias("top"), F.max_by("v", F.struct(F.col("c"), -F.col("v"))).alias("mode"))
    s = base.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.var_samp(v).alias("var"),
                 F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurt"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    skew = F.when((n > 2) & (F.col("sd") > 0), F.col("skew") * n * n / ((n - 1) * (n - 2))).otherwise(0.0)
    kurt = F.when((n > 3) & (F.col("sd") > 0),
                  (F.col("kurt") + 3) * n * n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
                  ).otherwise(0.0)
    median = exact_quantiles(base, v, [0.5])[0]
    return attach(s, top).select(
        "n", F.round("mean", 4).alias("mean"), F.round(F.lit(median).cast("double"), 4).alias("median"),
        F.when(F.col("top") > 1, F.col("mode")).alias("mode"), F.round("sd", 4).alias("std_dev"),
        F.round("var", 4).alias("variance"), F.round(skew, 4).alias("skewness"), F.round(kurt, 4).alias("kurtosis"),
        F.col("lo").alias("min"), F.col("hi").alias("max"))


def _pair_correlations(df, cols):
    """All pairwise correlations in one aggregate: column1, column2, n, r."""
    pairs = list(combinations(cols, 2))
    both = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull())
    wide = df.agg(F.array(*[
        F.struct(F.lit(a).alias("column1"), F.lit(b).alias("column2"), both(a, b).alias("n"),
                 F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for a, b in pairs]).alias("p"))
    return wide.select(F.inline("p"))


def correlations(df, cols, threshold=0.7):
    """AN-15."""
    strength = F.when(F.abs("r") >= 0.9, "VERY_STRONG").when(F.abs("r") >= 0.7, "STRONG").otherwise("MODERATE")
    return (_pair_correlations(df, cols).filter((F.col("n") >= 3) & (F.abs("r") >= threshold))
            .select("column1", "column2", F.round("r", 4).alias("correlation"), strength.alias("strength")))


def correlation_matrix(df, cols):
    """CH-09: every ordered pair, the diagonal included."""
    half = _pair_correlations(df, cols).select("column1", "column2", "r")
    flipped = half.select(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "r")
    own = df.agg(F.array(*[F.struct(F.lit(c).alias("column1"), F.lit(c).alias("column2"),
                                    F.corr(F.col(c).cast("double"), F.col(c).cast("double")).alias("r")) for c in cols]).alias("p"))
    return (half.unionByName(flipped).unionByName(own.select(F.inline("p")))
            .select("column1", "column2", F.round("r", 4).alias("correlation")))


def metric_pairs(df, cols, least=0.1):
    """CH-11: pairs worth plotting, strongest first."""
    return (_pair_correlations(df, cols).filter((F.col("n") >= 10) & (F.abs("r") > least))
            .orderBy(F.abs("r").desc(), "column1", "column2")
            .select("column1", "column2", F.round("r", 4).alias("correlation")))


def goal_vs_actual(df, value_col, target):
    """AN-16."""
    total = F.coalesce(F.sum(F.col(value_col).cast("double")), F.lit(0.0))
    return df.agg(total.alias("t")).select(
        F.lit(float(target)).alias("target"), F.round("t", 2).alias("actual"), F.round(F.col("t") - target, 2).alias("variance"),
        F.round(F.col("t") / target * 100 if target else F.lit(0.0), 2).alias("achievement_pct"),
        F.when(F.col("t") >= target, "MET").otherwise("NOT_MET").alias("status"))


def forecast_linear(series, periods=3):
    """AN-17: the next periods on the trend line."""
    conf = F.when(F.col("r2") > 0.8, "HIGH").when(F.col("r2") > 0.5, "MEDIUM").otherwise("LOW")
    return (_line(series).filter("n >= 3").select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"))
            .select("period", F.round(F.col("slope") * (F.col("n") + F.col("period") - 1) + F.col("intercept"), 2).alias("forecast_value"),
                    conf.alias("confidence")))


def forecast_smoothed(series, periods=3, alpha=0.3):
    """AN-17: exponential smoothing, written as one weighted sum."""
    placed = attach(indexed(series), series.agg(F.count("*").alias("n")))
    weight = F.when(F.col("i") == 0, F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(
        alpha * F.pow(F.lit(1 - alpha), F.col("n") - 1 - F.col("i")))
    level = placed.filter("n >= 3").agg(F.sum(weight * F.col("value")).alias("level")).filter("level is not null")
    return level.select(F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"), F.round("level", 2).alias("forecast_value"))


def concentration(df, value_col):
    """AN-18: sum of squared shares of the positive values, on a 0 to 10 000 scale."""
    v = F.when(F.col(value_col) > 0, F.col(value_col).cast("double"))
    hhi = F.col("sq") / (F.col("s") * F.col("s")) * 10000
    return df.agg(F.sum(v).alias("s"), F.sum(v * v).alias("sq"), F.max(v).alias("top")).select(
        F.round(F.coalesce(hhi, F.lit(0.0)), 2).alias("hhi"),
        F.when(F.col("s").isNull(), "N/A").when(hhi >= 2500, "HIGHLY_CONCENTRATED")
        .when(hhi >= 1500, "MODERATELY_CONCENTRATED").otherwise("UNCONCENTRATED").alias("interpretation"),
        F.round(F.col("top") / F.col("s") * 100, 2).alias("top_share_pct"))


def days_between(df, start_col, end_col, out="days"):
    """AN-19: whole elapsed days from ``start_col`` to ``end_col``."""
    return df.withColumn(out, F.datediff(F.col(end_col).cast("date"), F.col(start_col).cast("date")))


def frequency(df, col):
    """AN-20: count and share of the non-null values. The total is summed from the counts, not from the rows."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return attach(counts, total).select("value", "n", F.round(F.col("n") / F.col("total") * 100, 2).alias("percentage"))


def series_statistics(series):
    """AN-STATS: peak, low, averages, trend, outlier bounds, halves and above/below-mean counts of one series."""
    s = indexed(series)
    facts = s.agg(
        F.count("*").alias("n"), F.max("value").alias("peak"), F.min("value").alias("low"),
        F.max_by("period", F.struct(F.col("value"), -F.col("i"))).alias("peak_at"),
        F.min_by("period", F.struct(F.col("value"), F.col("i"))).alias("low_at"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.sum("value").alias("total"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.regr_slope("value", "i").alias("slope"), F.coalesce(F.regr_r2("value", "i"), F.lit(0.0)).alias("r2"),
        F.min_by("value", "i").alias("first"), F.max_by("value", "i").alias("last"))
    iqr = F.col("q")[2] - F.col("q")[0]
    low, high = F.col("q")[0] - 1.5 * iqr, F.col("q")[2] + 1.5 * iqr
    halves = attach(s, facts.select("n", "mean", low.alias("lo"), high.alias("hi"))).agg(
        F.avg(F.when(F.col("i") < F.floor(F.col("n") / 2), F.col("value"))).alias("half1"),
        F.avg(F.when(F.col("i") >= F.floor(F.col("n") / 2), F.col("value"))).alias("half2"),
        F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("n_out"),
        F.count_if(F.col("value") > F.col("mean")).alias("n_above"), F.count_if(F.col("value") < F.col("mean")).alias("n_below"))
    change = lambda a, b: F.round((F.col(b) - F.col(a)) / F.greatest(F.abs(a), F.lit(1.0)) * 100, 2)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return attach(facts, halves).select(
        "n", F.round("peak", 4).alias("peak"), day("peak_at").alias("peak_period"), F.round("low", 4).alias("low"),
        day("low_at").alias("low_period"), F.round("mean", 4).alias("mean"), F.round(F.col("q")[1], 4).alias("median"),
        F.round("sd", 4).alias("std_dev"), F.round("total", 4).alias("total"),
        F.when(F.col("n") < 3, "insufficient_data")
        .when(F.abs("slope") < 0.01 * F.greatest(F.abs("mean"), F.lit(1.0)), "stable")
        .when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("direction"),
        F.round("slope", 4).alias("slope"), F.round("r2", 4).alias("r_squared"),
        F.when(F.col("r2") > 0.7, "high").when(F.col("r2") > 0.4, "medium").otherwise("low").alias("confidence"),
        change("first", "last").alias("overall_change_pct"),
        F.when(F.col("n") >= 5, F.col("n_out")).otherwise(0).alias("n_outliers"),
        F.when(F.col("n") >= 4, change("half1", "half2")).alias("half_change_pct"), "n_above", "n_below")


def series_extremes(series, k=3):
    """AN-STATS: the k highest and k lowest points."""
    pick = lambda order, kind: series.orderBy(*order).limit(k).select(
        F.lit(kind).alias("kind"), F.date_format("period", "yyyy-MM-dd").alias("period"), F.round("value", 4).alias("value"))
    return pick([F.desc("value"), F.asc("period")], "top").unionByName(pick([F.asc("value"), F.asc("period")], "bottom"))


def suite(df, date_col=None, value_cols=(), category_cols=(), id_col=None, unit="month"):
    """AN-SUITE: every result that applies, as named frames. Series are shared between the period results."""
    out = {}
    for v in value_cols:
        out[f"{v}.percentiles"] = percentiles(df, [v])
        out[f"{v}.distribution"] = distribution(df, v)
        out[f"{v}.concentration"] = concentration(df, v)
        if date_col:
            monthly = time_series(df, date_col, v, unit)
            for name, u in (("yoy", "year"), ("qoq", "quarter"), ("mom", "month")):
                out[f"{v}.{name}"] = period_change(df, date_col, v, u)
            out.update({f"{v}.trend": trend(monthly), f"{v}.seasonality": seasonality(monthly),
                        f"{v}.outlier_periods": outlier_periods(monthly), f"{v}.forecast": forecast_linear(monthly),
                        f"{v}.statistics": series_statistics(monthly)})
        for c in category_cols:
            out[f"{v}.pareto.{c}"] = pareto(df, c, v)
    for c in category_cols:
        out[f"{c}.frequency"] = frequency(df, c)
    if len(value_cols) > 1:
        out["correlations"] = correlations(df, list(value_cols))
    if date_col and id_col:
        out["cohorts"] = cohorts(df, date_col, id_col)
        out["retention"] = cohort_retention(df, date_col, id_col)
    return out


def insights(df, date_col, value_cols, category_cols, unit="month"):
    """AN-SUITE: one row per finding (kind, subject, detail) for trends, correlations and the leading category."""
    parts = []
    for v in value_cols:
        t = trend(time_series(df, date_col, v, unit))
        parts.append(t.select(F.lit("trend").alias("kind"), F.lit(v).alias("subject"), F.col("direction").alias("detail")))
        for c in category_cols:
            best = df.groupBy(F.col(c).cast("string").alias("c")).agg(F.sum(v).alias("s")).orderBy(F.desc("s"), "c").limit(1)
            parts.append(best.select(F.lit("leading_category").alias("kind"), F.lit(f"{v} by {c}").alias("subject"), F.col("c").alias("detail")))
    if len(value_cols) > 1:
        parts.append(correlations(df, list(value_cols)).select(
            F.lit("correlation").alias("kind"), F.concat_ws(" ~ ", "column1", "column2").alias("subject"), F.col("strength").alias("detail")))
    return reduce(DataFrame.unionByName, parts)
