from pyspark.sql import functions as F

from tidymill.operators import structure as st
from tidymill.operators import whole_table as wt
from tidymill.sources.reader import spread
from . import query, table

MESS = """c_custkey AS _rid,
 CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 1 THEN ' Grand Total' WHEN c_custkey % 83 = 2 THEN 'full name' WHEN c_custkey % 7 = 3 THEN chr(39) || '00' || c_name
  WHEN c_custkey % 7 = 4 THEN chr(39) || 'twas' ELSE c_name END AS n1,
 CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 83 = 2 THEN 'Emial' WHEN c_custkey % 5 = 0 THEN '   ' WHEN c_custkey % 5 = 1 THEN 'caf' || chr(195) || chr(169) ELSE 'x' END AS n2,
 CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 83 = 2 THEN 'group' WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS n3"""
_CLEAN = """
WITH d AS (SELECT %s FROM customer),
c AS (SELECT _rid, CASE WHEN regexp_matches(n1, '^''[^\\p{Ll}]') THEN n1[2:] ELSE n1 END AS a,
  CASE WHEN trim(n2) = '' THEN NULL ELSE replace(n2, chr(195) || chr(169), 'é') END AS b, n3 AS g FROM d),
k AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL AND g IS NULL THEN 'GLOBAL-05' WHEN lower(trim(a)) = 'grand total' THEN 'GLOBAL-07'
  WHEN a = 'full name' AND b = 'Emial' AND g = 'group' THEN 'GLOBAL-08' END AS gone FROM c)
""" % MESS


def messy(spark, sf):
    df = table(spark, sf, "customer").selectExpr(*[x for x in [MESS.split(",\n")[0]]], *MESS.split(",\n")[1:])
    return spread(df, "_rid").toDF("_rid", "Full Name", "Emial", "Group")


@query("clean_global", _CLEAN + """
SELECT _rid, a AS full_name, b AS email, last_value(g IGNORE NULLS) OVER (ORDER BY _rid) AS "group" FROM k WHERE gone IS NULL""")
def clean_global(spark, sf):
    return wt.clean_global(messy(spark, sf))[0]


@query("audit_global", _CLEAN + """
SELECT rule, count(*) AS n FROM (
 SELECT gone AS rule FROM k WHERE gone IS NOT NULL
 UNION ALL SELECT 'GLOBAL-11' FROM d WHERE contains(n2, chr(195)) UNION ALL SELECT 'GLOBAL-15' FROM d WHERE trim(n2) = ''
 UNION ALL SELECT 'GLOBAL-14' FROM d WHERE regexp_matches(n1, '^''[^\\p{Ll}]')
 UNION ALL SELECT unnest(['GLOBAL-03', 'GLOBAL-03', 'GLOBAL-03', 'GLOBAL-13'])) GROUP BY rule""")
def audit_global(spark, sf):
    return wt.clean_global(messy(spark, sf))[2].groupBy("rule").agg(F.count("*").alias("n"))


@query("flags_global", """
SELECT rule, "column" FROM (VALUES ('GLOBAL-10 medium', 'full_name'), ('GLOBAL-10 medium', 'email')) t(rule, "column")""")
def flags_global(spark, sf):
    return wt.clean_global(messy(spark, sf))[1].select("rule", "column")


@query("column_findings", """
WITH d AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN 'x' END AS rare, 'same' AS constant, o_orderpriority AS normal FROM orders)
SELECT 'GLOBAL-01' AS rule, 'rare' AS "column" FROM d HAVING count(rare) < 0.05 * count(*)
UNION ALL SELECT 'GLOBAL-02', 'rare' FROM d HAVING min(rare) = max(rare) UNION ALL SELECT 'GLOBAL-02', 'constant' FROM d HAVING min(constant) = max(constant)""")
def column_findings(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 100 = 0 THEN 'x' END AS rare", "'same' AS constant", "o_orderpriority AS normal")
    return spark.createDataFrame(wt.column_findings(df), "rule string, column string")


@query("sparse_rows", "SELECT o_orderkey AS _rid FROM orders WHERE o_orderkey % 9 = 0")
def sparse_rows(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", *[f"CASE WHEN o_orderkey % 9 <> 0 OR {k} = 0 THEN o_orderstatus END AS c{k}" for k in range(6)])
    return wt.sparse_rows(df)


_TYPED = """CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' WHEN o_orderkey % 4 = 1 THEN '1,250' ELSE CAST(o_orderkey AS VARCHAR(20)) END AS a,
 CASE WHEN o_orderkey % 50 = 0 THEN 'yes' ELSE '3.5' END AS b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '2024-01-15' END AS c"""


@query("type_report", f"""
WITH d AS (SELECT o_orderkey, {_TYPED} FROM orders)
SELECT 'a' AS "column", 'integer' AS dominant_type, round(count(*) FILTER (a = 'n/a') / count(a) * 100, 2) AS mismatch_pct FROM d
UNION ALL SELECT 'b', 'float', round(count(*) FILTER (b = 'yes') / count(b) * 100, 2) FROM d UNION ALL SELECT 'c', 'date', 0""")
def type_report(spark, sf):
    parts = _TYPED.split(",\n")
    first, rest = parts[0], parts[1]
    b, c = rest.rsplit(", CASE", 1)
    return wt.type_report(table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", first, b, "CASE" + c))


@query("mixed_columns", f"""
WITH d AS (SELECT {_TYPED} FROM orders)
SELECT 'a' AS "column", 'integer' AS dominant_type, round(count(*) FILTER (a = 'n/a') / count(a) * 100, 2) AS mismatch_pct FROM d""")
def mixed_columns(spark, sf):
    return wt.mixed_columns(type_report(spark, sf))


_WIDE = [f"sum(CASE WHEN quarter(o_orderdate) = {q} THEN o_totalprice END) AS sales_q{q}" for q in (1, 2, 3, 4)]


@query("wide_to_long", f"""
WITH w AS (SELECT o_orderpriority AS region, {', '.join(_WIDE)} FROM orders GROUP BY 1)
SELECT region, period, round(v, 2) AS sales FROM (UNPIVOT w ON sales_q1 AS q1, sales_q2 AS q2, sales_q3 AS q3, sales_q4 AS q4 INTO NAME period VALUE v)""")
def wide_to_long(spark, sf):
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("region")).agg(*[F.expr(e) for e in _WIDE])
    groups = st.period_groups(wide.columns)
    out = st.wide_to_long(wide, ["region"], [c for c, _ in groups["sales"]], "sales")
    return out.select("region", "period", F.round("sales", 2).alias("sales"))


@query("forward_fill", """
WITH d AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS label FROM orders)
SELECT _rid, last_value(label IGNORE NULLS) OVER (ORDER BY _rid) AS label FROM d""")
def forward_fill(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS label")
    return st.fill_labels(df, ["_rid"])[0]


_GRAIN_SQL = "CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 2 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END"
_GRAIN = "CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM') WHEN 1 THEN concat('Q', quarter(o_orderdate), ' ', year(o_orderdate)) WHEN 2 THEN 'unknown' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"


@query("date_granularity", """
WITH d AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'quarterly' WHEN 2 THEN NULL ELSE 'daily' END AS g FROM orders)
SELECT 'd' AS "column", g AS granularity, count(*) AS n, round(count(*) / (SELECT count(g) FROM d), 4) AS share FROM d WHERE g IS NOT NULL GROUP BY g""")
def date_granularity(spark, sf):
    return st.granularity_report(table(spark, sf, "orders").selectExpr(f"{_GRAIN} AS d"), ["d"])


@query("mixed_granularity", "SELECT 'd' AS \"column\", 3 AS n_granularities")
def mixed_granularity(spark, sf):
    return st.mixed_granularity(date_granularity(spark, sf))


@query("promote_header", "SELECT c_custkey AS _rid, c_name AS customer, CAST(c_acctbal AS VARCHAR) AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey > 1")
def promote_header(spark, sf):
    df = table(spark, sf, "customer").selectExpr(
        "c_custkey AS _rid", "CASE c_custkey WHEN 0 THEN 'Customer report' WHEN 1 THEN 'customer' ELSE c_name END AS `Unnamed: 0`",
        "CASE c_custkey WHEN 0 THEN NULL WHEN 1 THEN 'balance' ELSE CAST(c_acctbal AS STRING) END AS `Unnamed: 1`",
        "CASE c_custkey WHEN 0 THEN NULL WHEN 1 THEN 'segment' ELSE c_mktsegment END AS `Unnamed: 2`")
    return st.promote_header(df, ["_rid"])


@query("stack_tables", """
SELECT c_custkey AS id, c_acctbal AS balance, 'customer' AS source_sheet FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'supplier' FROM supplier""")
def stack_tables(spark, sf):
    return st.stack_tables({"customer": table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance"),
                            "supplier": table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance"),
                            "part": table(spark, sf, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_size AS size")})


@query("transpose_table", """
WITH a AS (SELECT o_orderpriority AS p, count(*) AS n, round(max(o_totalprice)) AS top FROM orders GROUP BY 1)
SELECT 'n' AS record, """ + ", ".join(f"max(CASE WHEN p = '{p}' THEN CAST(n AS VARCHAR) END) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + """ FROM a
UNION ALL SELECT 'top', """ + ", ".join(f"max(CASE WHEN p = '{p}' THEN CAST(CAST(top AS BIGINT) AS VARCHAR) END)" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM a")
def transpose_table(spark, sf):
    agg = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"), F.round(F.max("o_totalprice")).cast("long").alias("top"))
    return st.transpose_table(agg, "p", ["n", "top"])
