import os
import tempfile
from functools import reduce

from pyspark.sql import functions as F

from tidymill.operators import basic as bs
from tidymill.operators import charts as ch
from tidymill.operators import compare as cp
from tidymill.operators import derived as dv
from tidymill.plans import profile as pf
from tidymill.sources import reader as rd
from tidymill.sources import sinks as sk
from . import query, table
from .analytics import _corr_union, _MEASURES, _pairs
from .records import _COPIES, copies


def scratch(spark, name):
    """A new folder for a written table: in the shared folder of the cluster where one is named, else a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        import uuid
        return f"{shared}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), name)


# ---- sources and sinks -----------------------------------------------------------------------------------------------------

@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    """Export, read back as text with sniffed delimiter, promote."""
    path = scratch(spark, "customer.csv")
    sk.export_csv(table(spark, sf, "customer").withColumn("_rid", F.col("c_custkey")), path)
    return rd.promote_types(rd.read_raw(spark, path)).drop("_rid")


_LINES = """CASE c_custkey % 4 WHEN 0 THEN CAST(c_custkey AS VARCHAR(20)) || ',"line one' || chr(10) || 'line two, ' || repeat(chr(34), 2) || 'quoted' || repeat(chr(34), 3) || ',' || c_name WHEN 1 THEN CAST(c_custkey AS VARCHAR(20)) || ',short'
 WHEN 2 THEN CAST(c_custkey AS VARCHAR(20)) || ',café,' || c_name ELSE CAST(c_custkey AS VARCHAR(20)) || ',too,many,' || c_name END"""


@query("csv_untidy", """
SELECT CAST(c_custkey AS VARCHAR) AS key, CASE c_custkey % 4 WHEN 0 THEN 'line one' || chr(10) || 'line two, "quoted"' WHEN 1 THEN 'short' ELSE 'café' END AS "note, free", CASE WHEN c_custkey % 4 <> 1 THEN c_name END AS name
FROM customer WHERE c_custkey % 4 <> 3""")
def csv_untidy(spark, sf):
    """Line ends and separators inside quotes, short rows (kept), rows with too many cells (dropped), a quoted header, files in two encodings."""
    return rd.read_raw(spark, untidy_files(spark, sf)).drop("_rid")


def untidy_files(spark, sf):
    path = scratch(spark, "untidy.csv")
    rows = table(spark, sf, "customer").select(F.expr(_LINES).alias("value"), F.col("c_custkey").alias("o"), F.pmod("c_custkey", F.lit(8)).alias("file"))
    for part, encoding in (("file % 2 = 0", "ISO-8859-1"), ("file % 2 = 1", "UTF-8")):
        # four files per encoding, each with a header, written line by line as they shall stand
        header = spark.range(8).select(F.lit('key,"note, free",name').alias("value"), F.lit(-1).cast("long").alias("o"), F.col("id").alias("file"))
        lines = header.unionByName(rows).filter(part).select("o", "file", F.posexplode(F.split("value", "\n")).alias("at", "line"))
        dealt = lines.repartition(8, "file").sortWithinPartitions("file", "o", "at").select("file", "line")
        dealt.write.mode("append").partitionBy("file").option("encoding", encoding).option("quote", "\u0002").option("sep", "\u0001").csv(path)
    return f"{path}/file=*"


_MIXED = """SELECT CAST(c_custkey AS VARCHAR) AS key, 'é ' || c_name AS name, CASE WHEN c_custkey % 3 <> 1 THEN CAST(c_nationkey AS VARCHAR) END AS nation, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS segment FROM customer"""


def mixed_files(spark, sf):
    """A folder of files whose headers, delimiters and encodings differ, all written in parallel."""
    path = scratch(spark, "mixed.csv")
    c = table(spark, sf, "customer").selectExpr("c_custkey AS key", "concat('é ', c_name) AS name", "c_nationkey AS nation", "c_mktsegment AS segment")
    for rest, columns, sep, encoding in ((0, ("key", "name", "nation"), ",", "UTF-8"), (1, ("name", "key"), ";", "ISO-8859-1"), (2, ("segment", "nation", "name", "key"), "\t", "UTF-8")):
        c.filter(f"key % 3 = {rest}").repartition(2, "key").select(*columns).write.mode("append").option("header", True).option("sep", sep).option("encoding", encoding).csv(path)
    return path


@query("csv_mixed_files", _MIXED)
def csv_mixed_files(spark, sf):
    """Every file by its own header, delimiter and encoding; columns meet by name."""
    return rd.read_raw(spark, mixed_files(spark, sf)).select("key", "name", "nation", "segment")


@query("csv_row_ids", "SELECT count(*) AS n, count(*) AS n_ids, true AS dense FROM customer")
def csv_row_ids(spark, sf):
    """Row ids are unique and without gaps inside each file."""
    ids = rd.read_raw(spark, mixed_files(spark, sf)).select("_rid")
    files = ids.groupBy(F.shiftright("_rid", rd.RECORD_BITS).alias("file")).agg(F.count("*").alias("n"), F.countDistinct("_rid").alias("d"), F.min("_rid").alias("low"), F.max("_rid").alias("high"))
    return files.agg(F.sum("n").alias("n"), F.sum("d").alias("n_ids"), F.bool_and(F.col("high") - F.col("low") + 1 == F.col("n")).alias("dense"))


@query("csv_rejected", "SELECT CAST(c_custkey AS VARCHAR) || ',too,many,' || c_name AS line FROM customer WHERE c_custkey % 4 = 3")
def csv_rejected(spark, sf):
    """The records that reading leaves out, for having more cells than their file has columns."""
    return rd.read_rejected(spark, untidy_files(spark, sf)).select("line")


@query("headerless_csv", "SELECT s_suppkey AS col_0, s_nationkey AS col_1, s_acctbal AS col_2 FROM supplier")
def headerless_csv(spark, sf):
    path = scratch(spark, "supplier.csv")
    table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").write.option("sep", "|").csv(path)
    return rd.promote_types(rd.read_raw(spark, path)).drop("_rid")


@query("column_kinds_raw", """SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'string'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'string'), ('yes_no', 'boolean'), ('nothing', 'empty')) t("column", kind)""")
def column_kinds_raw(spark, sf):
    df = table(spark, sf, "customer").selectExpr("*", "CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'No' END AS yes_no", "CAST(NULL AS STRING) AS nothing")
    return rd.column_kind(df, df.columns)


@query("coerce_columns", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 5 AS k, c_custkey FROM customer)
SELECT _rid, [1234.5, 12, NULL, NULL, 7][k + 1] AS f, [NULL, 12, NULL, NULL, 7][k + 1] AS i, [NULL, NULL, true, false, NULL][k + 1] AS b FROM d""")
def coerce_columns(spark, sf):
    text = "CASE c_custkey % 5 WHEN 0 THEN '$1,234.50' WHEN 1 THEN '12%' WHEN 2 THEN 'Yes' WHEN 3 THEN ' off ' ELSE '(7)' END"
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", f"{text} AS f", f"{text} AS i", f"{text} AS b")
    return rd.coerce_columns(df, {"f": "float", "i": "int", "b": "bool"})


@query("missing_report", """
SELECT 'a' AS "column", count(*) FILTER (o_orderkey % 4 = 0) AS null_count, round(count(*) FILTER (o_orderkey % 4 = 0) / count(*) * 100, 2) AS null_pct, 'median' AS suggested_fill FROM orders
UNION ALL SELECT 'b', count(*) FILTER (o_orderkey % 5 = 0), round(count(*) FILTER (o_orderkey % 5 = 0) / count(*) * 100, 2), 'mode' FROM orders
UNION ALL SELECT 'c', count(*) FILTER (o_orderkey % 6 = 0), round(count(*) FILTER (o_orderkey % 6 = 0) / count(*) * 100, 2), 'forward_fill' FROM orders""")
def missing_report(spark, sf):
    return sk.missing_report(table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS a", "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS b",
                                                                  "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS c", "o_custkey AS d"))


@query("audit_store", """
SELECT c_custkey AS row_index, 'c_name' AS column_name, 'FNAME-01' AS formula_id, c_name AS original_value, upper(c_name) AS new_value FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100""")
def audit_store(spark, sf):
    path = scratch(spark, "audit")
    audit = table(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"), F.lit("FNAME-01").alias("rule"), F.lit("c_name").alias("column"), F.col("c_name").alias("old_value"), F.upper("c_name").alias("new_value"))
    sk.append_audit(audit, path, 1, "2024-01-01 00:00:00")
    return sk.audit_page(spark.read.parquet(path), 50, 100).select("row_index", "column_name", "formula_id", "original_value", "new_value")


@query("audit_pages", """
WITH a AS (SELECT c_custkey AS row_index, 'c_name' AS column_name, 'FNAME-01' AS formula_id, CAST('2024-01-01' AS TIMESTAMP) AS t FROM customer
 UNION ALL SELECT c_custkey, 'c_phone', 'PHONE-02', CAST('2024-01-02' AS TIMESTAMP) FROM customer WHERE c_custkey % 3 = 0)
SELECT row_index, column_name, formula_id FROM (SELECT *, row_number() OVER (ORDER BY t, row_index, column_name, formula_id) - 1 AS place FROM a) WHERE place BETWEEN (SELECT count(*) - 20 FROM customer) AND (SELECT count(*) + 19 FROM customer)""")
def audit_pages(spark, sf):
    """The page across the seam of two appended jobs."""
    path, c = scratch(spark, "audit"), table(spark, sf, "customer")
    line = lambda df, rule, column: df.select(F.col("c_custkey").alias("_rid"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.lit(None).cast("string").alias("old_value"), F.lit("x").alias("new_value"))
    sk.append_paged_audit(line(c, "FNAME-01", "c_name"), path, 1, "2024-01-01 00:00:00")
    sk.append_paged_audit(line(c.filter("c_custkey % 3 = 0"), "PHONE-02", "c_phone"), path, 2, "2024-01-02 00:00:00")
    first = (c.count() - 20) // 10
    pages = [sk.audit_page_of(spark, path, first + k, 10) for k in range(4)]
    return reduce(lambda a, b: a.unionByName(b), pages).select("row_index", "column_name", "formula_id")


@query("outlier_listing", """
WITH q AS (SELECT quantile_cont(c_acctbal * c_acctbal * c_acctbal, 0.25) AS a, quantile_cont(c_acctbal * c_acctbal * c_acctbal, 0.75) AS b FROM customer)
SELECT c_custkey AS row_index, 'balance' AS column_name FROM customer, q WHERE power(c_acctbal, 3) < a - 1.5 * (b - a) OR power(c_acctbal, 3) > b + 1.5 * (b - a)""")
def outlier_listing(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "c_acctbal * c_acctbal * c_acctbal AS balance")
    found = bs.outliers(df, "balance").select("_rid", F.lit("PIPE-09").alias("rule"), F.lit("balance").alias("column"), F.col("value").cast("string").alias("value"))
    return sk.outlier_lines(sk.flag_lines(found, 1, "2024-01-01 00:00:00", "flag_outlier")).select("row_index", "column_name")


@query("manual_fill", "SELECT c_custkey AS _rid, CASE WHEN c_custkey % 10 = 0 THEN 'PATCHED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 20 = 0 THEN 1.5 ELSE c_acctbal END AS c_acctbal FROM customer")
def manual_fill(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "_rid").select("_rid", "c_mktsegment", "c_acctbal")
    patches = c.filter("_rid % 10 = 0").select("_rid", F.lit("c_mktsegment").alias("column"), F.lit("PATCHED").alias("value")).unionByName(
        c.filter("_rid % 20 = 0").select("_rid", F.lit("c_acctbal").alias("column"), F.lit("1.5").alias("value")))
    return sk.apply_patches(c, patches)[0]


@query("resolve_outliers", "SELECT c_custkey AS _rid, c_acctbal FROM customer WHERE c_acctbal >= 0")
def resolve_outliers(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("_rid"), "c_acctbal")
    return sk.resolve_outliers(c, c.select("_rid", F.when(F.col("c_acctbal") < 0, "remove").otherwise("keep").alias("decision")))


@query("select_columns", "SELECT c_custkey, c_name FROM customer")
def select_columns(spark, sf):
    left, missing = sk.drop_columns(table(spark, sf, "customer"), ["c_acctbal", "no_such_column"])
    return sk.confirmed_columns(left, ["c_custkey", "c_name"]) if missing == ["no_such_column"] else left


# ---- basic pass and quality ---------------------------------------------------------------------------------------------------

@query("basic_clean", f"""
WITH d AS ({_COPIES}), u AS (SELECT min(_rid) AS _rid, name, nation, segment FROM d GROUP BY name, nation, segment),
m AS (SELECT avg(nation) AS a FROM u), s AS (SELECT segment AS v FROM u WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT _rid, name, round(coalesce(nation, a), 6) AS nation, coalesce(segment, v) AS segment FROM u, m, s""")
def basic_clean(spark, sf):
    return bs.basic_clean(copies(spark, sf).withColumn("Mostly Empty", F.expr("CASE WHEN name = 'Customer#000000000' THEN 'x' END"))).withColumn("nation", F.round("nation", 6))


@query("null_rates", "SELECT 'a' AS \"column\", count(*) FILTER (o_orderkey % 3 = 0) AS null_count, round(count(*) FILTER (o_orderkey % 3 = 0) / count(*) * 100, 2) AS null_pct FROM orders UNION ALL SELECT 'b', 0, 0")
def null_rates(spark, sf):
    return bs.null_rates(table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 3 <> 0 THEN 1 END AS a", "2 AS b"))


@query("month_columns", "SELECT o_orderkey AS _rid, strftime(o_orderdate, '%Y-%m') AS order_date_month FROM orders")
def month_columns(spark, sf):
    return bs.month_columns(table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "date_format(o_orderdate, 'dd/MM/yyyy') AS order_date", "o_orderstatus AS date_kind")).select("_rid", "order_date_month")


@query("age_groups", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 100 AS age FROM customer)
SELECT _rid, CASE WHEN age <= 18 THEN '0-18' WHEN age <= 35 THEN '19-35' WHEN age <= 60 THEN '36-60' ELSE '60+' END AS age_group FROM d""")
def age_groups(spark, sf):
    return bs.age_groups(table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "c_custkey % 100 AS age", "c_acctbal AS average")).select("_rid", "age_group")


@query("fill_median", """
WITH d AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS v FROM orders)
SELECT _rid, round(coalesce(v, (SELECT median(v) FROM d)), 4) AS v FROM d""")
def fill_median(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS v")
    return bs.fill_number(df, "v", "median").select("_rid", F.round("v", 4).alias("v"))


@query("fill_mode", """
WITH d AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS v FROM orders)
SELECT _rid, coalesce(v, (SELECT v FROM d WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v FROM d""")
def fill_mode(spark, sf):
    return bs.fill_mode(table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS v"), "v")


@query("outliers", """
WITH q AS (SELECT quantile_cont(l_extendedprice * l_quantity, 0.25) AS a, quantile_cont(l_extendedprice * l_quantity, 0.75) AS b FROM lineitem)
SELECT l_orderkey * 10 + l_linenumber AS _rid, round(l_extendedprice * l_quantity, 4) AS value FROM lineitem, q WHERE l_extendedprice * l_quantity > b + 1.5 * (b - a) OR l_extendedprice * l_quantity < a - 1.5 * (b - a)""")
def outliers(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS _rid", "l_extendedprice * l_quantity AS v")
    return bs.outliers(df, "v").select("_rid", F.round("value", 4).alias("value"))


@query("quality_score", """
WITH d AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS a, o_orderstatus AS b, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '1' END AS c FROM orders),
m AS (SELECT (count(a) + count(b) + count(c)) / (3.0 * count(*)) * 100 AS complete, count(*) / (count(*) * 1.25) * 100 AS uniq FROM d)
SELECT round(complete, 2) AS completeness, round(uniq, 2) AS uniqueness, 66.67 AS consistency, round(complete, 2) AS integrity, round(0.4 * complete + 0.3 * uniq + 0.2 * 200 / 3 + 0.1 * complete, 2) AS score FROM m""")
def quality_score(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS a", "o_orderstatus AS b", "CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE '1' END AS c")
    return bs.quality_score(df, df.count() * 1.25)


# ---- comparison, derived metrics -------------------------------------------------------------------------------------------------

_SPLIT = """WITH a AS (SELECT sum(o_totalprice) AS p, sum(o_custkey) AS c FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT sum(o_totalprice) * 1.5 AS p, sum(o_custkey) AS c FROM orders WHERE year(o_orderdate) = 1997),
r AS (SELECT 'total_price' AS "column", a.p AS x, b.p AS y FROM a, b UNION ALL SELECT 'customer_id', a.c, b.c FROM a, b)"""


def _delta(spark, sf):
    od = table(spark, sf, "orders")
    left = od.filter(F.year("o_orderdate") == 1996).selectExpr("o_totalprice AS total_price", "o_custkey AS customer_id", "o_orderstatus AS state")
    right = od.filter(F.year("o_orderdate") == 1997).selectExpr("o_totalprice * 1.5 AS totalprice", "o_custkey AS customerid", "o_orderpriority AS other")
    return cp.deltas(left, right)


@query("compare_datasets", _SPLIT + 'SELECT "column", round(x, 2) AS period1_value, round(y, 2) AS period2_value, round((y - x) / abs(x) * 100, 2) AS change_pct FROM r')
def compare_datasets(spark, sf):
    return _delta(spark, sf)


@query("compare_significant", _SPLIT + 'SELECT "column", round(x, 2) AS period1_value, round(y, 2) AS period2_value, round((y - x) / abs(x) * 100, 2) AS change_pct FROM r WHERE abs((y - x) / abs(x) * 100) >= 20')
def compare_significant(spark, sf):
    return cp.significant(_delta(spark, sf))


def _ratios(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS _rid", "l_extendedprice AS revenue", "l_quantity * 7 + 0.13D AS qty", "l_extendedprice * l_tax AS profit", "CAST(l_shipdate AS DATE) AS admission",
                                                   "date_add(CAST(l_shipdate AS DATE), l_linenumber) AS discharge")


@query("derived_metrics", """
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS _rid, l_extendedprice AS revenue, l_quantity * 7 + CAST(0.13 AS DOUBLE) AS qty, l_extendedprice * l_tax AS profit, l_linenumber AS days FROM lineitem)
SELECT _rid, CAST(round(CAST(profit / revenue * 100 AS DECIMAL(28, 10)), 2) AS DOUBLE) AS profit_margin_pct, CAST(round(CAST(revenue / qty AS DECIMAL(28, 10)), 2) AS DOUBLE) AS revenue_per_unit,
 CAST(round(CAST(profit / qty AS DECIMAL(28, 10)), 2) AS DOUBLE) AS profit_per_unit, days AS length_of_stay_days FROM d""")
def derived_metrics(spark, sf):
    return dv.add_derived_metrics(_ratios(spark, sf)).select("_rid", "profit_margin_pct", "revenue_per_unit", "profit_per_unit", "length_of_stay_days")


@query("derived_metric_report", """
SELECT 'profit_margin_pct' AS metric, 'profit' AS numerator, 'revenue' AS denominator, count(*) AS n FROM lineitem UNION ALL SELECT 'revenue_per_unit', 'revenue', 'qty', count(*) FROM lineitem
UNION ALL SELECT 'profit_per_unit', 'profit', 'qty', count(*) FROM lineitem UNION ALL SELECT 'length_of_stay_days', 'discharge', 'admission', count(*) FROM lineitem""")
def derived_metric_report(spark, sf):
    return dv.describe_metrics(_ratios(spark, sf)).select("metric", "numerator", "denominator", "n")


_GROWTH = """WITH s AS (SELECT {p} AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1), l AS (SELECT *, lag(value) OVER (ORDER BY period) AS b FROM s)
SELECT period, round(value, 2) AS value, round((value - b) / b * 100, 2) AS {c} FROM l"""


@query("derived_yoy", _GROWTH.format(p="year(o_orderdate)", c="yoy_change_pct"))
def derived_yoy(spark, sf):
    return dv.growth(table(spark, sf, "orders").withColumn("period", F.year("o_orderdate")), "period", "o_totalprice", "yoy_change_pct")


@query("derived_mom", _GROWTH.format(p="strftime(o_orderdate, '%Y-%m')", c="growth_rate_pct"))
def derived_mom(spark, sf):
    return dv.growth(table(spark, sf, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM")), "period", "o_totalprice", "growth_rate_pct")


# ---- charts ------------------------------------------------------------------------------------------------------------------------

@query("chart_timeseries", "SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS x, o_orderstatus AS \"group\", round(sum(o_totalprice), 4) AS y FROM orders GROUP BY 1, 2")
def chart_timeseries(spark, sf):
    return ch.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "sum", "o_orderstatus")


@query("chart_events_daily", "SELECT strftime(ts, '%Y-%m-%d') AS x, count(*) AS y FROM events GROUP BY 1")
def chart_events_daily(spark, sf):
    return ch.time_series(table(spark, sf, "events"), "ts", unit="day")


@query("chart_topk", "SELECT CAST(o_custkey AS VARCHAR) AS name, count(*) AS value FROM orders GROUP BY 1 ORDER BY value DESC, name LIMIT 20")
def chart_topk(spark, sf):
    return ch.distribution(table(spark, sf, "orders"), "o_custkey")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("chart_grouped", "SELECT o_orderstatus AS x, " + ", ".join(f"round(avg(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 4) AS \"{p}\"" for p in _PRIORITIES) + " FROM orders GROUP BY 1")
def chart_grouped(spark, sf):
    return ch.grouped_series(table(spark, sf, "orders"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("chart_scatter")
def chart_scatter(spark, sf):
    return ch.scatter(table(spark, sf, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS _rid", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("chart_line", "SELECT l_quantity AS x, round(avg(l_extendedprice), 4) AS y FROM lineitem GROUP BY 1")
def chart_line(spark, sf):
    return ch.line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("chart_ranked_bar", "SELECT p_brand AS x, round(sum(p_retailprice), 4) AS y FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, x LIMIT 30")
def chart_ranked_bar(spark, sf):
    return ch.ranked_bar(table(spark, sf, "part"), "p_brand", "p_retailprice")


@query("chart_correlation", f"""
WITH p AS ({_corr_union(_MEASURES)}), a AS (SELECT * FROM p UNION ALL SELECT column2, column1, r FROM p UNION ALL SELECT unnest({_MEASURES!r}) AS c, c, 1.0)
SELECT column1, column2, round(r, 4) AS correlation FROM a""")
def chart_correlation(spark, sf):
    from tidymill.operators.analytics import correlation_matrix
    return correlation_matrix(table(spark, sf, "lineitem"), _MEASURES)


_PRICED = "(SELECT *, l_extendedprice * l_tax AS tax_paid FROM lineitem)"


@query("chart_metric_pairs", f"WITH p AS ({_corr_union(_MEASURES + ['tax_paid'], _PRICED)}) SELECT column1, column2, round(r, 4) AS correlation FROM p WHERE abs(r) > 0.1")
def chart_metric_pairs(spark, sf):
    from tidymill.operators.analytics import metric_pairs
    return metric_pairs(table(spark, sf, "lineitem").withColumn("tax_paid", F.expr("l_extendedprice * l_tax")), _MEASURES + ["tax_paid"])


@query("chart_suite")
def chart_suite(spark, sf):
    """All suite charts of the orders table: one line per point."""
    df = table(spark, sf, "orders").withColumn("_rid", F.col("o_orderkey"))
    points = ch.suite(df, pf.column_roles(df))
    lines = [p.select(F.lit("/".join(str(k) for k in key)).alias("chart"), F.to_json(F.struct("*")).alias("point")) for key, p in points.items()]
    return reduce(lambda a, b: a.unionByName(b), lines)


# ---- the whole way -------------------------------------------------------------------------------------------------------------------

_RAW = """c_custkey AS _rid, CASE WHEN c_custkey % 41 = 0 THEN 'Total' ELSE concat('  dr. ', substr(md5(cast(c_custkey as string)), 1, 6), ' ', lower(c_mktsegment)) END AS `Full Name`,
 concat('User', c_custkey % 900, '@GMAIL.com') AS emial, concat('$', cast(c_acctbal as string)) AS amount, date_format(date_add(DATE '1990-01-01', cast(c_custkey % 3000 as int)), 'dd/MM/yyyy') AS `Joining Date`,
 CASE c_custkey % 3 WHEN 0 THEN 'usa' WHEN 1 THEN 'Nepal' ELSE 'DEU' END AS country, CASE c_custkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'OPEN' ELSE 'on hold' END AS status"""


def _full(spark, sf):
    from tidymill.plans.full_clean import clean_table
    table(spark, sf, "customer").createOrReplaceTempView("customer_raw")
    return clean_table(spark.sql(f"SELECT {_RAW} FROM customer_raw"), "2024-01-01", workdir=scratch(spark, "full"))


@query("full_clean", """
WITH d AS (SELECT c_custkey AS _rid, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 1)) AS a, c_custkey AS k, c_acctbal AS x FROM customer WHERE c_custkey % 41 <> 0)
SELECT _rid, 'user' || (k % 900) || '@gmail.com' AS email, x AS amount, strftime(DATE '1990-01-01' + CAST(k % 3000 AS INT), '%Y-%m-%d') AS joining_date, ['United States', 'Nepal', 'Germany'][k % 3 + 1] AS country,
 ['Completed', 'Active', 'Pending', 'Pending'][k % 4 + 1] AS status FROM d""")
def full_clean(spark, sf):
    return _full(spark, sf).table.select("_rid", "email", "amount", F.date_format("joining_date", "yyyy-MM-dd").alias("joining_date"), "country", "status")


@query("full_clean_fills", """
SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 5 = 0 THEN 'MV-AMOUNT' END AS rule, CAST(CASE WHEN o_orderkey % 5 = 0 THEN round((o_orderkey % 9 + 1) * (o_orderkey % 7 + 2.5), 2) END AS DOUBLE) AS filled FROM orders WHERE o_orderkey % 5 = 0""")
def full_clean_fills(spark, sf):
    """Each filled cell has its line: amounts that quantity and price determine, on typed columns."""
    from tidymill.plans.full_clean import clean_table
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CAST(o_orderkey % 9 + 1 AS DOUBLE) AS quantity", "o_orderkey % 7 + 2.5D AS price",
                                               "CASE WHEN o_orderkey % 5 <> 0 THEN round((o_orderkey % 9 + 1) * (o_orderkey % 7 + 2.5D), 2) END AS amount")
    done = clean_table(df, "2024-01-01", workdir=scratch(spark, "fills"))
    return done.audit.filter("column = 'amount' AND old_value IS NULL").select("_rid", "rule", F.col("new_value").try_cast("double").alias("filled"))


@query("full_clean_checks", """
SELECT 'COND-11' AS rule, count(*) AS n FROM orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT 'COND-12', count(*) FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 2) > 1)""")
def full_clean_checks(spark, sf):
    """Totals against their parts, and keys with contradictory statuses, on columns found by name and type."""
    from tidymill.operators import validation
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "o_custkey AS customer_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'active' ELSE 'inactive' END AS status", "o_orderkey % 50 AS part_a", "o_orderkey % 30 AS part_b",
                                               "o_orderkey % 50 + o_orderkey % 30 + CASE WHEN o_orderkey % 6 = 0 THEN 7 ELSE 0 END AS total")
    found = validation.violations(df, validation.bind_columns(df.columns, {"customer_id": "UID"}), as_of="2024-01-01")
    return found.filter("rule in ('COND-11', 'COND-12')").groupBy("rule").agg(F.count("*").alias("n"))


@query("full_clean_rules", """
SELECT rule, n FROM (SELECT 'EMAIL-01' AS rule, count(*) AS n FROM customer WHERE c_custkey % 41 <> 0 UNION ALL SELECT 'GLOBAL-07', count(*) FROM customer WHERE c_custkey % 41 = 0
 UNION ALL SELECT 'FNAME-03', count(*) FROM customer WHERE c_custkey % 41 <> 0 UNION ALL SELECT 'DATE-07', count(*) FROM customer WHERE c_custkey % 41 <> 0)""")
def full_clean_rules(spark, sf):
    kept = _full(spark, sf).audit.filter("rule in ('EMAIL-01', 'GLOBAL-07', 'FNAME-03', 'DATE-07')")
    return kept.groupBy("rule").agg(F.count("*").alias("n"))
