from functools import reduce

from pyspark.sql import functions as F

from tidymill.plans import profile as pf
from tidymill.sources.reader import spread
from . import query, table

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _union(columns, template, source):
    return " UNION ALL ".join(template.format(c=c, source=source) for c in columns)


@query("profile_columns", _union(_ORDERS, """SELECT '{c}' AS "column", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS null_count,
 round(count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) / count({c}), 4) AS numeric_share FROM {source}""", "orders"))
def profile_columns(spark, sf):
    return pf.profile_columns(spread(table(spark, sf, "orders"), "o_orderkey")).select("column", "rows", "null_count", "numeric_share")


@query("distinct_counts", _union(_ORDERS, "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, count({c}) AS filled FROM {source}", "orders"))
def distinct_counts(spark, sf):
    return pf.distinct_counts(table(spark, sf, "orders"), _ORDERS)


_MIXED = """CASE WHEN c_custkey % 4 = 0 THEN 'no' ELSE 'a' || CAST(c_custkey AS VARCHAR(9)) || '@x.org' END AS a,
CASE WHEN c_custkey % 10 = 0 THEN '?' ELSE '+1 555 01' || CAST(10 + c_custkey % 80 AS VARCHAR(9)) END AS b,
CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'y' END AS c, CASE WHEN c_custkey % 2 = 0 THEN '2024/01/15' ELSE '15 Jan 2024' END AS d,
CASE WHEN c_custkey % 2 = 0 THEN '10:30' ELSE '7 pm' END AS e, 'https://site' || CAST(c_custkey AS VARCHAR(9)) || '.org/x' AS f"""


def _mixed(spark, sf):
    import re
    exprs = [x.strip() for x in re.split(r"(?<= AS [a-f]),", _MIXED)]
    return spread(table(spark, sf, "customer").selectExpr("c_custkey AS _rid", *exprs), "_rid")


@query("value_pattern_types", f"""
WITH d AS (SELECT {_MIXED} FROM customer)
SELECT 'a' AS "column", 'EMAIL' AS formula_set, round(0.6 + (count(*) FILTER (a <> 'no') / count(*) - 0.5) * 0.4, 4) AS confidence FROM d
UNION ALL SELECT 'b', 'PHONE', round(0.6 + (count(*) FILTER (b <> '?') / count(*) - 0.5) * 0.4, 4) FROM d
UNION ALL SELECT 'c', 'BOOL', 0.68 UNION ALL SELECT 'd', 'DATE', 0.7 UNION ALL SELECT 'e', 'TIME', 0.7 UNION ALL SELECT 'f', 'URL', 0.8""")
def value_pattern_types(spark, sf):
    return pf.semantic_types(_mixed(spark, sf)).select("column", "formula_set", "confidence")


@query("semantic_types", """
SELECT * FROM (VALUES ('c_custkey', 'RANK', 0.4, false, 'low'), ('c_name', 'FNAME', 0.85, true, 'medium'), ('c_nationkey', 'QTY', 0.4, false, 'low'),
 ('c_acctbal', 'AMT', 0.85, false, 'low'), ('c_mktsegment', 'CAT', 0.85, false, 'low')) t("column", formula_set, confidence, is_pii, sensitivity)""")
def semantic_types(spark, sf):
    # the smallest key is 0 in the data, so keys are shifted to start at 1
    df = table(spark, sf, "customer").withColumn("c_custkey", F.col("c_custkey") + 1)
    return pf.semantic_types(df).select("column", "formula_set", "confidence", "is_pii", "sensitivity")


@query("semantic_type_report", """
SELECT * FROM (VALUES ('RANK', 1, 0.4, 0.4, 0, 0), ('FNAME', 1, 0.85, 0.85, 1, 0), ('QTY', 1, 0.4, 0.4, 0, 0), ('AMT', 1, 0.85, 0.85, 0, 0), ('CAT', 1, 0.85, 0.85, 0, 0))
 t(formula_set, n_columns, min_confidence, avg_confidence, n_pii, n_high)""")
def semantic_type_report(spark, sf):
    df = table(spark, sf, "customer").withColumn("c_custkey", F.col("c_custkey") + 1)
    return pf.type_report(pf.semantic_types(df))


@query("merge_types", """
SELECT * FROM (VALUES ('a', 'EMAIL', 0.95, 'external'), ('b', 'PHONE', 0.7, 'agreed'), ('c', 'BOOL', 0.68, 'conflict'), ('d', 'DATE', 0.7, 'low_confidence'),
 ('e', 'TIME', 0.7, 'detected'), ('f', 'URL', 0.8, 'detected')) t("column", formula_set, confidence, decision)""")
def merge_types(spark, sf):
    outside = spark.createDataFrame([("a", "EMAIL", 0.95), ("b", "PHONE", 0.7), ("c", "STAT", 0.7), ("d", "FISC", 0.3)], "column string, formula_set string, confidence double")
    return pf.merge_types(pf.semantic_types(_mixed(spark, sf)), outside)


def _roles(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "o_orderkey AS seq", "o_custkey * 100000 + o_orderkey AS invoice_no", "o_orderstatus AS status", "o_totalprice AS price",
                                               "o_orderdate AS day", "o_orderpriority AS priority", "'x' AS same", "o_orderkey % 2 AS odd", "md5(cast(o_orderkey as string)) AS blob",
                                               "concat('Z', o_custkey % 20) AS zip_code")
    df = spread(df, "_rid")
    return df, pf.column_roles(df)


_ROLES = """(VALUES ('seq', 'sequence'), ('invoice_no', 'identifier'), ('status', 'category'), ('price', 'metric'), ('day', 'date'), ('priority', 'category'), ('same', 'constant'),
 ('odd', 'boolean'), ('blob', 'text'), ('zip_code', 'code')) t("column", role)"""


@query("column_roles", f'SELECT "column", role FROM {_ROLES}')
def column_roles(spark, sf):
    return _roles(spark, sf)[1].select("column", "role")


@query("plottable_columns", f"""
SELECT "column", role, role IN ('category', 'boolean', 'date', 'code') AS x_axis, role = 'metric' AS y_axis FROM {_ROLES} WHERE role NOT IN ('identifier', 'sequence', 'constant')""")
def plottable_columns(spark, sf):
    return pf.plottable(_roles(spark, sf)[1])


@query("column_kinds", f"""
SELECT "column", CASE WHEN "column" IN ('status', 'priority', 'same') THEN 'category_tiny' WHEN role = 'date' THEN 'date' WHEN role = 'metric' THEN 'numeric' WHEN role = 'boolean' THEN 'boolean'
 WHEN role IN ('identifier', 'sequence') THEN 'id' WHEN "column" = 'zip_code' THEN 'category_medium' ELSE 'category_large' END AS kind FROM {_ROLES}""")
def column_kinds(spark, sf):
    return pf.column_kinds(_roles(spark, sf)[1])


@query("column_relevance", f"""
SELECT "column", CASE WHEN role IN ('identifier', 'sequence', 'constant') THEN 'drop' ELSE 'keep' END AS decision,
 CASE WHEN role IN ('identifier', 'sequence', 'constant') THEN role ELSE 'useful' END AS reason FROM {_ROLES}""")
def column_relevance(spark, sf):
    df, roles = _roles(spark, sf)
    return pf.relevance(roles, df.count())


@query("dataset_shape", """
SELECT CASE WHEN max(n) >= 2 THEN 'longitudinal' ELSE 'cross_sectional' END AS shape FROM (SELECT count(DISTINCT o_orderdate) AS n FROM orders GROUP BY o_custkey)""")
def dataset_shape(spark, sf):
    return pf.dataset_shape(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


@query("dataset_shapes", """
SELECT 'orders' AS name, CASE WHEN max(n) >= 2 THEN 'longitudinal' ELSE 'cross_sectional' END AS dataset_type, 'o_orderdate' AS time_col, CASE WHEN max(n) >= 2 THEN 'o_orderstatus' END AS entity_col
 FROM (SELECT count(DISTINCT o_orderdate) AS n FROM orders GROUP BY o_orderstatus)
UNION ALL SELECT 'one_day', CASE WHEN max(n) >= 2 THEN 'longitudinal' ELSE 'cross_sectional' END, 'day', CASE WHEN max(n) >= 2 THEN 'c_mktsegment' END FROM (SELECT count(DISTINCT c_custkey * 0) AS n FROM customer GROUP BY c_mktsegment)
UNION ALL SELECT 'customer', CASE WHEN count(*) > 0 THEN 'flat' END, NULL, NULL FROM customer""")
def dataset_shapes(spark, sf):
    """Entities over time, one moment, and a table without time."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    frames = {"orders": table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice"), "one_day": c.withColumn("day", F.lit("2024-01-01")), "customer": c}
    parts = [pf.detect_dataset_shape(df).withColumn("name", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).select("name", "dataset_type", "time_col", "entity_col")
