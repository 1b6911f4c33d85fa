from pyspark.sql import functions as F

from tidymill.operators import temporal as tm
from tidymill.operators.rules import apply_rules
from . import query
from .people import dirty

REF = "2000-06-30"

DATE_TXT_SQL = """CASE o_orderkey % 12
 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
 WHEN 2 THEN strftime(o_orderdate, '%d %b %Y') WHEN 3 THEN strftime(o_orderdate, '%B %d, %Y')
 WHEN 4 THEN '01/01/1900' WHEN 5 THEN CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR)
 WHEN 6 THEN '3 weeks ago' WHEN 7 THEN strftime(o_orderdate, '%Y-%m') WHEN 8 THEN '31/31/1999' WHEN 9 THEN 'soon'
 WHEN 10 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END"""
DATE_TXT = """CASE o_orderkey % 12
 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy')
 WHEN 2 THEN date_format(o_orderdate, 'dd MMM yyyy') WHEN 3 THEN date_format(o_orderdate, 'MMMM dd, yyyy')
 WHEN 4 THEN '01/01/1900' WHEN 5 THEN CAST(datediff(CAST(o_orderdate AS DATE), DATE '1899-12-30') AS STRING)
 WHEN 6 THEN '3 weeks ago' WHEN 7 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 8 THEN '31/31/1999' WHEN 9 THEN 'soon'
 WHEN 10 THEN date_format(o_orderdate, 'dd.MM.yyyy') ELSE date_format(o_orderdate, 'yyyy/MM/dd') END"""


@query("clean_date", f"""
WITH d AS (SELECT o_orderkey AS _rid, {DATE_TXT_SQL} AS raw FROM orders),
p AS (SELECT *, CASE WHEN raw = '01/01/1900' THEN NULL
  WHEN regexp_full_match(raw, '[0-9]{{5}}') THEN DATE '1899-12-30' + CAST(raw AS INT)
  WHEN raw = '3 weeks ago' THEN DATE '{REF}' - 21 WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}') THEN CAST(raw || '-01' AS DATE)
  ELSE CAST(try_strptime(raw, ['%Y-%m-%d', '%d/%m/%Y', '%d %b %Y', '%B %d, %Y', '%d.%m.%Y', '%Y/%m/%d']) AS DATE) END AS day FROM d)
SELECT _rid, strftime(day, '%Y-%m-%d') AS birth_date, strftime(day, '%A') AS weekday,
  concat_ws(',', CASE WHEN raw = '31/31/1999' OR raw = 'soon' THEN 'DATE-03' END,
   CASE WHEN regexp_full_match(raw, '[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}}') AND CAST(raw[1:2] AS INT) <= 12 AND CAST(raw[4:5] AS INT) <= 12
        AND raw[1:2] <> raw[4:5] THEN 'DATE-02' END,
   CASE WHEN day > DATE '{REF}' THEN 'DATE-04' END,
   CASE WHEN datediff('day', day, DATE '{REF}') < 0 THEN 'DATE-05' END) AS flags FROM p""")
def clean_date(spark, sf):
    res = apply_rules(dirty(spark, sf, DATE_TXT, "birth_date", "orders", "o_orderkey"), [tm.date_rules("birth_date", REF)])
    return res.annotated.select("_rid", F.date_format("birth_date", "yyyy-MM-dd").alias("birth_date"),
                                F.col("birth_date_weekday").alias("weekday"), "flags")


@query("date_forms", f"""
WITH d AS (SELECT o_orderkey % 12 AS k FROM orders)
SELECT CASE WHEN k = 5 THEN 'DATE-09' WHEN k = 6 THEN 'DATE-14' WHEN k = 7 THEN 'DATE-08' ELSE 'DATE-01' END AS form, count(*) AS n
FROM d WHERE k NOT IN (4, 8, 9) GROUP BY 1""")
def date_forms(spark, sf):
    res = apply_rules(dirty(spark, sf, DATE_TXT, "order_date", "orders", "o_orderkey"), [tm.date_rules("order_date", REF)])
    return res.table.filter("order_date_form is not null").groupBy(F.col("order_date_form").alias("form")).agg(F.count("*").alias("n"))


TIME_TXT = """CASE event_id % 8 WHEN 0 THEN '3:05 PM' WHEN 1 THEN '15:05' WHEN 2 THEN '9:5:7' WHEN 3 THEN '11pm'
 WHEN 4 THEN '25:10' WHEN 5 THEN '08:30 UTC+05:45' WHEN 6 THEN '12:00 a.m.' ELSE NULL END"""


@query("clean_time", f"""
WITH d AS (SELECT event_id AS _rid, event_id % 8 AS k FROM events)
SELECT _rid, ['15:05', '15:05', '09:05:07', '23:00', '25:10', '08:30', '00:00', NULL][k + 1] AS t,
  CASE WHEN k = 5 THEN 'UTC+05:45' END AS t_timezone,
  ['Afternoon', 'Afternoon', 'Morning', 'Night', NULL, 'Morning', 'Night', NULL][k + 1] AS t_bucket,
  CASE WHEN k = 4 THEN 'TIME-03' ELSE '' END AS flags FROM d""")
def clean_time(spark, sf):
    return apply_rules(dirty(spark, sf, TIME_TXT, "t", "events", "event_id"), [tm.time_rules("t")]).annotated


DTM_TXT_SQL = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M')
 WHEN 2 THEN strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') ELSE 'never' END"""
DTM_TXT = """CASE event_id % 4 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") WHEN 1 THEN date_format(ts, 'dd/MM/yyyy HH:mm')
 WHEN 2 THEN date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm') ELSE 'never' END"""
_DTM = f"""
WITH d AS (SELECT event_id AS _rid, user_id, {DTM_TXT_SQL} AS raw FROM events),
p AS (SELECT *, try_strptime(raw, ['%Y-%m-%dT%H:%M:%S', '%d/%m/%Y %H:%M', '%Y-%m-%d %H:%M']) AS t FROM d)
"""


@query("clean_datetime", _DTM + """
SELECT _rid, strftime(t, '%Y-%m-%d %H:%M:%S') AS iso, strftime(t, '%Y-%m-%d') AS day, strftime(t, '%H:%M:%S') AS clock,
 CAST(epoch_us(t) AS BIGINT) AS sort_key FROM p""")
def clean_datetime(spark, sf):
    res = apply_rules(dirty(spark, sf, DTM_TXT, "t", "events", "event_id"), [tm.datetime_rules("t", REF)])
    return res.table.select("_rid", F.col("t_iso").alias("iso"), F.col("t_date").alias("day"), F.col("t_time").alias("clock"),
                            F.col("t_sort_key").alias("sort_key"))


@query("flags_repeated_timestamp", _DTM + """
SELECT _rid, strftime(t, '%Y-%m-%d %H:%M:%S') AS value FROM p WHERE t IS NOT NULL AND
 (user_id, t) IN (SELECT (user_id, t) FROM p WHERE t IS NOT NULL GROUP BY user_id, t HAVING count(*) > 1)""")
def flags_repeated_timestamp(spark, sf):
    from . import table
    df = table(spark, sf, "events").selectExpr("event_id AS _rid", "user_id", f"{DTM_TXT} AS t")
    return apply_rules(df, [tm.datetime_rules("t", REF, "user_id")]).flags.filter("rule = 'DTM-06'").select("_rid", "value")


DUR_TXT = """CASE o_orderkey % 8 WHEN 0 THEN '2 weeks 3 days' WHEN 1 THEN '12:00' WHEN 2 THEN 'two hours' WHEN 3 THEN '90 min'
 WHEN 4 THEN CAST(o_orderkey % 10 AS VARCHAR(9)) WHEN 5 THEN 'long' WHEN 6 THEN '-4' ELSE CASE WHEN o_orderkey % 80 = 7 THEN '9 years' ELSE '1 month' END END"""


@query("clean_duration", f"""
WITH d AS (SELECT o_orderkey AS _rid, o_orderkey % 8 AS k, {DUR_TXT} AS raw FROM orders),
p AS (SELECT *, CASE k WHEN 0 THEN 17.0 WHEN 1 THEN 0.5 WHEN 2 THEN 7200.0 / 86400 WHEN 3 THEN 5400.0 / 86400 WHEN 4 THEN CAST(raw AS DOUBLE)
  WHEN 5 THEN NULL WHEN 6 THEN -4 ELSE CASE WHEN raw = '9 years' THEN 9 * 31556952.0 / 86400 ELSE 2629746.0 / 86400 END END AS x FROM d),
q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM p)
SELECT _rid, round(x, 6) AS days, CASE k WHEN 0 THEN 'week' WHEN 2 THEN 'hour' WHEN 3 THEN 'minute' WHEN 7 THEN
  CASE WHEN raw = '9 years' THEN 'year' ELSE 'month' END END AS unit,
 concat_ws(',', CASE WHEN k IN (4, 6) THEN 'DUR-07' END, CASE WHEN x < 0 THEN 'DUR-04' END,
  CASE WHEN x < a - 3 * (b - a) OR x > b + 3 * (b - a) THEN 'DUR-06' END) AS flags FROM p, q""")
def clean_duration(spark, sf):
    res = apply_rules(dirty(spark, sf, DUR_TXT, "d", "orders", "o_orderkey"), [tm.duration_rules("d")])
    return res.annotated.select("_rid", F.round("d", 6).alias("days"), F.col("d_original_unit").alias("unit"), "flags")


FISC_TXT = """CASE o_orderkey % 12 WHEN 0 THEN 'FY24' WHEN 1 THEN 'fiscal year 2021' WHEN 2 THEN 'Q3 2022' WHEN 3 THEN 'q1-fy98'
 WHEN 4 THEN '2nd Quarter 2020' WHEN 5 THEN '2023/24' WHEN 6 THEN 'Academic Year 2019-2020' WHEN 7 THEN 'sem 2'
 WHEN 8 THEN 'autumn 2020' WHEN 9 THEN 'Term 3' WHEN 10 THEN NULL ELSE '2019 FY' END"""


@query("clean_fiscal", """
WITH d AS (SELECT o_orderkey AS _rid, o_orderkey % 12 AS k FROM orders)
SELECT _rid, ['FY2024', 'FY2021', 'Q3 FY2022', 'Q1 FY1998', 'Q2 FY2020', 'AY 2023-24', 'AY 2019-20', 'Semester 2', 'Fall 2020', 'Term 3', NULL, 'FY2019'][k + 1] AS p,
 [20240, 20210, 20223, 19981, 20202, 20230, 20190, NULL, NULL, NULL, NULL, 20190][k + 1] AS p_sort_key,
 CASE WHEN k = 10 THEN 'FISC-07' ELSE '' END AS flags FROM d""")
def clean_fiscal(spark, sf):
    return apply_rules(dirty(spark, sf, FISC_TXT, "p", "orders", "o_orderkey"), [tm.fiscal_rules("p")]).annotated
