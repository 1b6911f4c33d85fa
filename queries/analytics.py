from pyspark.sql import functions as F

from tidymill.operators import analytics as an
from . import query, table

_PERIOD = """
WITH s AS (SELECT date_trunc('{unit}', o_orderdate) AS period, sum(o_totalprice) AS value FROM orders
           WHERE o_orderdate IS NOT NULL GROUP BY 1),
t AS (SELECT *, lag(period) OVER (ORDER BY period) AS before, lag(value) OVER (ORDER BY period) AS previous FROM s)
SELECT {before} AS from_period, {period} AS to_period, round(previous, 2) AS previous_value,
       round(value, 2) AS current_value, round((value - previous) / previous * 100, 2) AS change_pct
FROM t WHERE previous IS NOT NULL AND previous <> 0"""


def _period_sql(unit, label):
    return _PERIOD.format(unit=unit, before=label.format(d="before"), period=label.format(d="period"))


@query("an_yoy_change", _period_sql("year", "strftime({d}, '%Y')"))
def an_yoy_change(spark, sf):
    return an.period_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "year")


@query("an_mom_change", _period_sql("month", "strftime({d}, '%Y-%m')"))
def an_mom_change(spark, sf):
    return an.period_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month")


@query("an_qoq_change", _period_sql("quarter", "year({d}) || 'Q' || quarter({d})"))
def an_qoq_change(spark, sf):
    return an.period_change(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "quarter")


@query("an_moving_average", """
SELECT event_id, CASE WHEN row_number() OVER w >= 7 THEN
       round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) END AS moving_average
FROM events WINDOW w AS (ORDER BY ts, event_id)""")
def an_moving_average(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    return an.moving_average(ev, ["ts", "event_id"], "value", 7).select("event_id", F.round("moving_average", 4).alias("moving_average"))


@query("an_cumulative_sum", """
SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderdate, o_orderkey
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total FROM orders""")
def an_cumulative_sum(spark, sf):
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return (an.cumulative_sum(od, ["o_orderdate", "o_orderkey"], "o_totalprice")
            .select("o_orderkey", F.round("running_total", 2).alias("running_total")))


@query("an_cohort", """
SELECT cohort, count(*) AS n_customers FROM
 (SELECT o_custkey, strftime(min(o_orderdate), '%Y') AS cohort FROM orders GROUP BY o_custkey) GROUP BY cohort""")
def an_cohort(spark, sf):
    return an.cohorts(table(spark, sf, "orders"), "o_orderdate", "o_custkey").groupBy("cohort").agg(F.count("*").alias("n_customers"))


@query("an_cohort_retention", """
WITH a AS (SELECT DISTINCT o_custkey AS id, date_trunc('month', o_orderdate) AS m FROM orders),
f AS (SELECT id, min(m) AS cohort FROM a GROUP BY id),
g AS (SELECT cohort, datediff('month', cohort, m) AS age FROM a JOIN f USING (id))
SELECT strftime(cohort, '%Y-%m') AS cohort, count(*) FILTER (age = 0) AS cohort_size,
""" + ", ".join(f"round(count(*) FILTER (age = {p}) / count(*) FILTER (age = 0) * 100, 2) AS period_{p}" for p in range(7)) + """
FROM g GROUP BY cohort""")
def an_cohort_retention(spark, sf):
    return an.cohort_retention(table(spark, sf, "orders"), "o_orderdate", "o_custkey", 6)


_PARETO = """
WITH c AS (SELECT p_brand AS category, sum(p_retailprice) AS value FROM part GROUP BY 1),
t AS (SELECT *, row_number() OVER w - 1 AS pos, sum(value) OVER (ORDER BY value DESC, category ROWS UNBOUNDED PRECEDING) AS run,
      sum(value) OVER () AS total, count(*) OVER () AS n FROM c WINDOW w AS (ORDER BY value DESC, category)),
p AS (SELECT category, round(value, 2) AS value, round(value / total * 100, 2) AS percentage,
      round(run / total * 100, 2) AS cumulative_pct, pos < 0.2 * n AS in_top_20_pct FROM t)
"""


@query("an_pareto", _PARETO + "SELECT * FROM p")
def an_pareto(spark, sf):
    return an.pareto(table(spark, sf, "part"), "p_brand", "p_retailprice")


@query("an_pareto_customers", """
WITH c AS (SELECT o_custkey AS category, sum(o_totalprice) AS value FROM orders GROUP BY 1),
t AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) - 1 AS pos,
      sum(value) OVER (ORDER BY value DESC, category ROWS UNBOUNDED PRECEDING) AS run,
      sum(value) OVER () AS total, count(*) OVER () AS n FROM c)
SELECT category, round(value, 2) AS value, round(value / total * 100, 2) AS percentage,
       round(run / total * 100, 2) AS cumulative_pct, pos < 0.2 * n AS in_top_20_pct FROM t""")
def an_pareto_customers(spark, sf):
    return an.pareto(table(spark, sf, "orders"), "o_custkey", "o_totalprice")


@query("an_pareto_top_share", _PARETO + "SELECT max(cumulative_pct) AS top_20_pct_contribution FROM p WHERE in_top_20_pct")
def an_pareto_top_share(spark, sf):
    return an.pareto_top_share(an_pareto(spark, sf))


_DAILY = """
WITH s AS (SELECT CAST(ts AS DATE) AS period, sum(value) AS value FROM events GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS i FROM s),
m AS (SELECT avg(value) AS mean, var_pop(value) AS var, count(*) AS n, regr_slope(value, i) AS slope,
      regr_intercept(value, i) AS intercept, coalesce(regr_r2(value, i), 0) AS r2 FROM x)
"""


def daily(spark, sf):
    return an.time_series(table(spark, sf, "events"), "ts", "value", "day")


def _monthly_sql():
    return _DAILY.replace("CAST(ts AS DATE)", "CAST(date_trunc('month', o_orderdate) AS DATE)").replace(
        "sum(value) AS value FROM events", "sum(o_totalprice) AS value FROM orders")


def monthly(spark, sf):
    return an.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month")


def _auto(lag, name):
    return (f"CASE WHEN max(n) >= {2 * lag} AND max(n) >= 12 AND max(var) > 0 THEN "
            f"sum((value - mean) * (v{lag} - mean)) / ((max(n) - {lag}) * max(var)) END AS {name}")


@query("an_seasonality", _monthly_sql() + f""",
y AS (SELECT value, lead(value, 7) OVER w AS v7, lead(value, 12) OVER w AS v12, lead(value, 4) OVER w AS v4, m.* FROM x, m
      WINDOW w AS (ORDER BY i)),
a AS (SELECT {_auto(7, 'weekly')}, {_auto(12, 'monthly')}, {_auto(4, 'quarterly')} FROM y),
g AS (SELECT *, greatest(coalesce(abs(weekly), 0), coalesce(abs(monthly), 0), coalesce(abs(quarterly), 0)) AS top FROM a)
SELECT CASE WHEN top <= 0.5 THEN 'none' WHEN abs(weekly) = top THEN 'weekly' WHEN abs(monthly) = top THEN 'monthly'
       ELSE 'quarterly' END AS seasonality, round(weekly, 3) AS autocorrelation_weekly,
       round(monthly, 3) AS autocorrelation_monthly, round(quarterly, 3) AS autocorrelation_quarterly FROM g""")
def an_seasonality(spark, sf):
    return an.seasonality(monthly(spark, sf))


@query("an_turning_points", _monthly_sql() + """,
y AS (SELECT period, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM x WINDOW w AS (ORDER BY period))
SELECT strftime(period, '%Y-%m-%d') AS period, round(value, 2) AS value,
       CASE WHEN value > a THEN 'peak' ELSE 'trough' END AS kind
FROM y WHERE (value > a AND value > b) OR (value < a AND value < b)""")
def an_turning_points(spark, sf):
    return an.turning_points(monthly(spark, sf))


@query("an_trend", _monthly_sql() + """
SELECT CASE WHEN abs(slope) < 0.01 * mean THEN 'FLAT' WHEN slope > 0 THEN 'UP' ELSE 'DOWN' END AS direction,
       round(slope, 4) AS slope, round(r2, 4) AS r_squared,
       CASE WHEN r2 >= 0.8 THEN 'HIGH' WHEN r2 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM m""")
def an_trend(spark, sf):
    return an.trend(monthly(spark, sf))


@query("an_outlier_periods", _monthly_sql() + """,
r AS (SELECT period, value, slope * i + intercept AS fit, value - (slope * i + intercept) AS resid FROM x, m),
d AS (SELECT stddev_samp(resid) AS sd FROM r)
SELECT strftime(period, '%Y-%m-%d') AS period, round(value, 2) AS actual, round(fit, 2) AS predicted,
       round(resid, 2) AS deviation, round(resid / sd, 2) AS std_devs FROM r, d WHERE abs(resid) > 2 * sd""")
def an_outlier_periods(spark, sf):
    return an.outlier_periods(monthly(spark, sf))


@query("an_rank_within_group", """
SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS o_totalprice_rank FROM orders""")
def an_rank_within_group(spark, sf):
    od = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return an.rank_within(od, "o_orderpriority", "o_totalprice").select("o_orderkey", "o_totalprice_rank")


@query("an_percentiles", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
       round(quantile_cont({c}, 0.75), 2) AS p75, round(quantile_cont({c}, 0.9), 2) AS p90 FROM lineitem"""
                                             for c in ("l_quantity", "l_extendedprice", "l_discount")))
def an_percentiles(spark, sf):
    return an.percentiles(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("an_distribution", """
WITH c AS (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1),
t AS (SELECT max(c) AS top FROM c), k AS (SELECT min(v) AS mode FROM c, t WHERE c.c = t.top)
SELECT count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median,
       (SELECT mode FROM k) AS mode, round(stddev_samp(l_quantity), 4) AS std_dev, round(var_samp(l_quantity), 4) AS variance,
       round(skewness(l_quantity), 4) AS skewness,
       round((kurtosis_pop(l_quantity) + 3) * count(*)::DOUBLE * count(*) * (count(*) + 1) / ((count(*)::DOUBLE - 1) * (count(*) - 2) * (count(*) - 3)) - 3 * (count(*)::DOUBLE - 1) * (count(*) - 1) / ((count(*)::DOUBLE - 2) * (count(*) - 3)), 4) AS kurtosis,
       min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem""")
def an_distribution(spark, sf):
    return an.distribution(table(spark, sf, "lineitem"), "l_quantity")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


def _corr_union(cols, src="lineitem"):
    return " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r FROM {src}" for a, b in _pairs(cols))


@query("an_correlation", f"""
WITH p AS ({_corr_union(_MEASURES)})
SELECT column1, column2, round(r, 4) AS correlation, CASE WHEN abs(r) >= 0.9 THEN 'VERY_STRONG' ELSE 'STRONG' END AS strength
FROM p WHERE abs(r) >= 0.7""")
def an_correlation(spark, sf):
    return an.correlations(table(spark, sf, "lineitem"), _MEASURES)


@query("an_goal", """
SELECT 1000000000.0 AS target, round(sum(o_totalprice), 2) AS actual, round(sum(o_totalprice) - 1e9, 2) AS variance,
       round(sum(o_totalprice) / 1e9 * 100, 2) AS achievement_pct,
       CASE WHEN sum(o_totalprice) >= 1e9 THEN 'MET' ELSE 'NOT_MET' END AS status FROM orders""")
def an_goal(spark, sf):
    return an.goal_vs_actual(table(spark, sf, "orders"), "o_totalprice", 1e9)


@query("an_forecast_linear", _monthly_sql() + """
SELECT p AS period, round(slope * (n + p - 1) + intercept, 2) AS forecast_value,
       CASE WHEN r2 > 0.8 THEN 'HIGH' WHEN r2 > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
FROM m, (VALUES (1), (2), (3)) v(p)""")
def an_forecast_linear(spark, sf):
    return an.forecast_linear(monthly(spark, sf))


@query("an_forecast_smoothed", _monthly_sql() + """,
r AS (SELECT list_reduce(list(value ORDER BY i), lambda a, b: 0.3 * b + 0.7 * a) AS level FROM x)
SELECT p AS period, round(level, 2) AS forecast_value FROM r, (VALUES (1), (2), (3)) v(p)""")
def an_forecast_smoothed(spark, sf):
    return an.forecast_smoothed(monthly(spark, sf))


@query("an_concentration", """
WITH s AS (SELECT sum(CASE WHEN o_totalprice > 0 THEN o_totalprice END) AS t FROM orders)
SELECT round(sum(power(o_totalprice / t, 2)) * 10000, 2) AS hhi, 'UNCONCENTRATED' AS interpretation,
       round(max(o_totalprice) / max(t) * 100, 2) AS top_share_pct FROM orders, s WHERE o_totalprice > 0""")
def an_concentration(spark, sf):
    return an.concentration(table(spark, sf, "orders"), "o_totalprice")


@query("an_days_between", """
SELECT l_orderkey, l_linenumber, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def an_days_between(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    od = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return an.days_between(li.join(od, "l_orderkey"), "o_orderdate", "l_shipdate").select("l_orderkey", "l_linenumber", "days")


@query("an_frequency", """
SELECT event_type AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS percentage
FROM events WHERE event_type IS NOT NULL GROUP BY event_type""")
def an_frequency(spark, sf):
    return an.frequency(table(spark, sf, "events"), "event_type")


@query("an_series_statistics", _monthly_sql() + """,
q AS (SELECT *, quantile_cont(value, 0.25) OVER () AS q1, quantile_cont(value, 0.75) OVER () AS q3 FROM x, m),
h AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT max(n) AS n, round(max(value), 4) AS peak, strftime(arg_max(period, value), '%Y-%m-%d') AS peak_period,
 round(min(value), 4) AS low, strftime(arg_min(period, value), '%Y-%m-%d') AS low_period, round(avg(value), 4) AS mean,
 round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std_dev, round(sum(value), 4) AS total,
 CASE WHEN abs(max(slope)) < 0.01 * greatest(abs(max(mean)), 1) THEN 'stable' WHEN max(slope) > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
 round(max(slope), 4) AS slope, round(max(r2), 4) AS r_squared,
 CASE WHEN max(r2) > 0.7 THEN 'high' WHEN max(r2) > 0.4 THEN 'medium' ELSE 'low' END AS confidence,
 round((arg_max(value, i) - arg_min(value, i)) / greatest(abs(arg_min(value, i)), 1) * 100, 2) AS overall_change_pct,
 count(*) FILTER (value < lo OR value > hi) AS n_outliers,
 round((avg(value) FILTER (i >= n // 2) - avg(value) FILTER (i < n // 2)) / greatest(abs(avg(value) FILTER (i < n // 2)), 1) * 100, 2) AS half_change_pct,
 count(*) FILTER (value > mean) AS n_above, count(*) FILTER (value < mean) AS n_below FROM h""")
def an_series_statistics(spark, sf):
    return an.series_statistics(monthly(spark, sf))


@query("an_series_extremes", _monthly_sql() + """
(SELECT 'top' AS kind, strftime(period, '%Y-%m-%d') AS period, round(value, 4) AS value FROM x ORDER BY x.value DESC, x.period LIMIT 3)
UNION ALL
(SELECT 'bottom', strftime(period, '%Y-%m-%d'), round(value, 4) FROM x ORDER BY x.value, x.period LIMIT 3)""")
def an_series_extremes(spark, sf):
    return an.series_extremes(monthly(spark, sf))


@query("an_insights", _monthly_sql() + """,
b AS (SELECT o_orderpriority AS c, sum(o_totalprice) AS s FROM orders GROUP BY 1 ORDER BY s DESC, c LIMIT 1)
SELECT 'trend' AS kind, 'o_totalprice' AS subject,
       CASE WHEN abs(slope) < 0.01 * mean THEN 'FLAT' WHEN slope > 0 THEN 'UP' ELSE 'DOWN' END AS detail FROM m
UNION ALL SELECT 'leading_category', 'o_totalprice by o_orderpriority', c FROM b""")
def an_insights(spark, sf):
    return an.insights(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], ["o_orderpriority"])


@query("an_suite")
def an_suite(spark, sf):
    """All suite frames of the orders table, one line per frame and row."""
    frames = an.suite(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], ["o_orderpriority"], "o_custkey")
    from functools import reduce
    lines = [df.select(F.lit(name).alias("result"), F.to_json(F.struct("*")).alias("row")) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), lines)
