from pyspark.sql import functions as F

from tidymill.operators import numeric as nm
from tidymill.operators.rules import apply_rules
from . import query, table
from .people import dirty

AMOUNT = """CASE o_orderkey % 11 WHEN 0 THEN '$1,234,567.89' WHEN 1 THEN '1.234,56 €' WHEN 2 THEN 'EUR 77.5' WHEN 3 THEN 'two hundred and five'
 WHEN 4 THEN '1e5' WHEN 5 THEN NULL WHEN 6 THEN '-12.345' WHEN 7 THEN 'free' WHEN 8 THEN CASE WHEN o_orderkey % 121 = 8 THEN '0' ELSE '10' END
 ELSE CAST(o_totalprice AS VARCHAR(30)) END"""
_AMOUNT = f"""
WITH d AS (SELECT o_orderkey AS _rid, o_orderkey % 11 AS k, {AMOUNT} AS raw FROM orders),
p AS (SELECT *, CASE k WHEN 0 THEN 1234567.89 WHEN 1 THEN 1234.56 WHEN 2 THEN 77.5 WHEN 3 THEN 205 WHEN 4 THEN 100000 WHEN 6 THEN -12.35
  WHEN 7 THEN NULL ELSE CAST(TRY_CAST(raw AS DOUBLE) AS DOUBLE) END AS x, CASE k WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'EUR' END AS cur FROM d),
s AS (SELECT avg(x) AS mean, stddev_samp(x) AS sd, count(*) FILTER (x = 0) AS z, count(x) AS n FROM p)
"""


@query("clean_amount", _AMOUNT + """
SELECT _rid, x AS price, cur AS price_currency, concat_ws(',', CASE WHEN k = 7 THEN 'AMT-08' END, CASE WHEN cur IS NOT NULL THEN 'AMT-09' END,
 CASE WHEN abs((x - mean) / sd) > 3 THEN 'AMT-06' END, CASE WHEN x = 0 AND z < 0.05 * n THEN 'AMT-07' END, CASE WHEN x < 0 THEN 'AMT-05' END) AS flags FROM p, s""")
def clean_amount(spark, sf):
    return apply_rules(dirty(spark, sf, AMOUNT, "price", "orders", "o_orderkey"), [nm.amount_rules("price")]).annotated


@query("audit_amount", """
WITH d AS (SELECT o_orderkey % 11 AS k FROM orders)
SELECT rule, n FROM (SELECT 'AMT-01' AS rule, count(*) FILTER (k IN (0, 1, 2)) + count(*) FILTER (k IN (0, 1, 2)) AS n FROM d
 UNION ALL SELECT 'AMT-02', count(*) FILTER (k = 0) FROM d UNION ALL SELECT 'AMT-03', count(*) FILTER (k = 1) FROM d
 UNION ALL SELECT 'AMT-13', count(*) FILTER (k = 3) FROM d UNION ALL SELECT 'AMT-12', count(*) FILTER (k = 4) FROM d)""")
def audit_amount(spark, sf):
    res = apply_rules(dirty(spark, sf, AMOUNT, "price", "orders", "o_orderkey"), [nm.amount_rules("price")])
    kept = res.audit.filter("rule in ('AMT-02', 'AMT-03', 'AMT-13', 'AMT-12', 'AMT-01')")
    derived = res.table.filter("price_currency is not null").agg(F.count("*").alias("n")).select(F.lit("AMT-01").alias("rule"), "n")
    return kept.groupBy("rule").agg(F.count("*").alias("n")).unionByName(derived).groupBy("rule").agg(F.sum("n").alias("n"))


QUANTITY = """CASE l_orderkey % 10 WHEN 0 THEN 'twenty one' WHEN 1 THEN 'tweleve' WHEN 2 THEN 'approx 50' WHEN 3 THEN '50 kg' WHEN 4 THEN '7.5'
 WHEN 5 THEN '-2' WHEN 6 THEN '12.0004' WHEN 7 THEN NULL WHEN 8 THEN CASE WHEN l_orderkey % 100 = 8 THEN '0' ELSE '30' END ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END"""


@query("clean_quantity", f"""
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS _rid, l_orderkey % 10 AS k, {QUANTITY} AS raw FROM lineitem),
p AS (SELECT *, CASE k WHEN 0 THEN 21 WHEN 1 THEN 12 WHEN 2 THEN 50 WHEN 3 THEN 50 WHEN 6 THEN 12 ELSE CAST(raw AS DOUBLE) END AS x FROM d),
s AS (SELECT avg(x) AS mean, stddev_samp(x) AS sd, count(*) FILTER (x = 0) AS z, count(x) AS n FROM p)
SELECT _rid, x AS qty, CASE WHEN k = 3 THEN 'kg' END AS qty_unit, concat_ws(',', CASE WHEN k = 2 THEN 'QTY-03' END, CASE WHEN k = 4 THEN 'QTY-04' END,
 CASE WHEN x < 0 THEN 'QTY-05' END, CASE WHEN abs((x - mean) / sd) > 3 THEN 'QTY-06' END, CASE WHEN x = 0 AND z < 0.05 * n THEN 'QTY-07' END) AS flags FROM p, s""")
def clean_quantity(spark, sf):
    df = dirty(spark, sf, QUANTITY, "qty", "lineitem", "l_orderkey * 10 + l_linenumber")
    return apply_rules(df, [nm.quantity_rules("qty")]).annotated


PERCENT = """CASE l_orderkey % 6 WHEN 0 THEN '12%' WHEN 1 THEN 'fifty percent' WHEN 2 THEN ' 7.5 % ' WHEN 3 THEN '140' WHEN 4 THEN NULL ELSE CAST(l_linenumber AS VARCHAR(9)) END"""


@query("clean_percentage", f"""
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS _rid, l_orderkey % 6 AS k, {PERCENT} AS raw FROM lineitem),
p AS (SELECT *, CASE k WHEN 0 THEN 12 WHEN 1 THEN 50 WHEN 2 THEN 7.5 ELSE CAST(raw AS DOUBLE) END AS x FROM d),
q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM p)
SELECT _rid, x AS rate, concat_ws(',', CASE WHEN x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a) THEN 'PCT-04' END,
  CASE WHEN x NOT BETWEEN 0 AND 100 THEN 'PCT-02' END) AS flags FROM p, q""")
def clean_percentage(spark, sf):
    df = dirty(spark, sf, PERCENT, "rate", "lineitem", "l_orderkey * 10 + l_linenumber")
    return apply_rules(df, [nm.percentage_rules("rate")]).annotated


@query("percentage_from_share", "SELECT l_orderkey * 10 + l_linenumber AS _rid, round(l_discount * 100, 6) AS discount_rate FROM lineitem")
def percentage_from_share(spark, sf):
    df = dirty(spark, sf, "CAST(l_discount AS STRING)", "discount_rate", "lineitem", "l_orderkey * 10 + l_linenumber")
    res = apply_rules(df, [nm.percentage_rules("discount_rate")]).table
    return res.select("_rid", F.round("discount_rate", 6).alias("discount_rate"))


SCORE = """CASE o_orderkey % 8 WHEN 0 THEN 'A-' WHEN 1 THEN '4/5' WHEN 2 THEN '8 out of 10' WHEN 3 THEN 'excelent' WHEN 4 THEN '3.456' WHEN 5 THEN 'f' WHEN 6 THEN NULL ELSE '2.5' END"""


@query("clean_score", """
WITH d AS (SELECT o_orderkey AS _rid, o_orderkey % 8 AS k FROM orders)
SELECT _rid, ['3.7', '80', '80', 'Excellent', '3.456', '0', NULL, '2.5'][k + 1] AS grade, [3.7, 80, 80, NULL, 3.46, 0, NULL, 2.5][k + 1] AS grade_value,
 CASE WHEN k IN (1, 2) THEN 'SCORE-02' ELSE '' END AS flags FROM d""")
def clean_score(spark, sf):
    return apply_rules(dirty(spark, sf, SCORE, "grade", "orders", "o_orderkey"), [nm.score_rules("grade")]).annotated


@query("score_letters_to_percent", "SELECT o_orderkey AS _rid, ['94.5', '81', '29.5', 'Z'][o_orderkey % 4 + 1] AS grade FROM orders")
def score_letters_to_percent(spark, sf):
    df = dirty(spark, sf, "CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'B-' WHEN 2 THEN 'F' ELSE 'Z' END", "grade", "orders", "o_orderkey")
    return apply_rules(df, [nm.score_rules("grade", "percent")]).table.select("_rid", "grade")


CURRENCY = "CASE o_orderkey % 5 WHEN 0 THEN '$' WHEN 1 THEN 'eur' WHEN 2 THEN ' GBP ' WHEN 3 THEN 'XXX' ELSE NULL END"


@query("clean_currency", """
SELECT o_orderkey AS _rid, ['USD', 'EUR', 'GBP', 'XXX', NULL][o_orderkey % 5 + 1] AS cur, CASE WHEN o_orderkey % 5 = 3 THEN 'CUR-01' ELSE '' END AS flags FROM orders""")
def clean_currency(spark, sf):
    return apply_rules(dirty(spark, sf, CURRENCY, "cur", "orders", "o_orderkey"), [nm.currency_rules("cur")]).annotated


RANK = """CASE WHEN c_custkey = 0 THEN '0' WHEN c_custkey = 1 THEN 'first' WHEN c_custkey = 2 THEN '2nd' WHEN c_custkey % 10 = 3 THEN NULL
 WHEN c_custkey % 10 = 4 THEN CAST(c_custkey + 1 AS VARCHAR(9)) ELSE CAST(c_custkey AS VARCHAR(9)) || 'th' END"""
_RANK = f"""
WITH d AS (SELECT c_custkey AS _rid, {RANK} AS raw FROM customer),
p AS (SELECT _rid, CASE raw WHEN 'first' THEN 1 ELSE CAST(regexp_extract(raw, '^([0-9]+)', 1) AS BIGINT) END AS r FROM d WHERE raw IS NOT NULL)
"""


@query("clean_rank", _RANK + "SELECT c_custkey AS _rid, r, CASE WHEN r <= 0 THEN 'RANK-04' ELSE '' END AS flags FROM customer LEFT JOIN p ON c_custkey = _rid")
def clean_rank(spark, sf):
    return apply_rules(dirty(spark, sf, RANK, "r"), [nm.rank_rules("r")]).annotated


@query("flags_repeated_rank", _RANK + "SELECT _rid, r AS value FROM p WHERE r IN (SELECT r FROM p GROUP BY r HAVING count(*) > 1)")
def flags_repeated_rank(spark, sf):
    return (apply_rules(dirty(spark, sf, RANK, "r"), [nm.rank_rules("r")]).flags.filter("rule = 'RANK-02'")
            .select("_rid", F.col("value").cast("long").alias("value")))


@query("missing_ranks", _RANK + """,
u AS (SELECT DISTINCT r FROM p WHERE r >= 1), n AS (SELECT r, coalesce(lag(r) OVER (ORDER BY r), 0) AS before FROM u)
SELECT before + 1 AS gap_start, r - 1 AS gap_end FROM n WHERE r - before > 1""")
def missing_ranks(spark, sf):
    return nm.missing_ranks(apply_rules(dirty(spark, sf, RANK, "r"), [nm.rank_rules("r")]).table, "r")


_CALC = """
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS _rid, l_quantity AS qty, l_tax AS rate,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 50 = 1 THEN 1.0 ELSE l_quantity * l_tax END AS total FROM lineitem)
"""


def _calc(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS _rid", "l_quantity AS qty", "l_tax AS rate",
        "CASE WHEN l_orderkey % 50 = 0 THEN NULL WHEN l_orderkey % 50 = 1 THEN 1.0D ELSE l_quantity * l_tax END AS total")


@query("formula_discovery", _CALC + """
SELECT 'multiply' AS operation, 'qty' AS "left", 'rate' AS "right",
 round(count(*) FILTER (abs(qty * rate - total) < 0.01) / count(total), 4) AS match_rate FROM d""")
def formula_discovery(spark, sf):
    df = _calc(spark, sf)
    f = nm.discover_formula(df, "total", ["qty", "rate"])
    return spark.createDataFrame([(f["operation"], f["left"], f["right"], round(f["match_rate"], 4))], "operation string, left string, right string, match_rate double")


@query("clean_calculated", _CALC + """
SELECT _rid, qty, rate, coalesce(total, round(qty * rate, 2)) AS total, concat_ws(',', CASE WHEN abs(qty * rate - total) > 0.01 THEN 'CALC-02' END,
  CASE WHEN total IS NULL THEN 'CALC-03' END) AS flags FROM d""")
def clean_calculated(spark, sf):
    df = _calc(spark, sf)
    return apply_rules(df, [nm.calculated_rules("total", nm.discover_formula(df, "total", ["qty", "rate"]))]).annotated
