from pyspark.sql import functions as F

from tidymill.operators import organisation as og
from tidymill.operators.rules import apply_rules
from tidymill.operators.similarity import variant_groups
from . import query, table
from .people import dirty

PRODUCT = """CASE p_partkey % 6 WHEN 0 THEN 'aspirin 500MG tab*' WHEN 1 THEN NULL WHEN 2 THEN 'coat xl @home' WHEN 3 THEN 'vitamin-C (pure)' ELSE p_name END"""
CODE = "CAST(p_partkey - p_partkey % 3 AS STRING)"
_PRODUCT = f"""
WITH d AS (SELECT p_partkey AS _rid, p_partkey % 6 AS k, p_partkey - p_partkey % 3 AS code, {PRODUCT} AS raw FROM part),
p AS (SELECT _rid, code, CASE k WHEN 0 THEN 'Aspirin 500mg Tab' WHEN 2 THEN 'Coat XL Home' WHEN 3 THEN 'Vitamin-c (pure)' WHEN 1 THEN NULL
  ELSE array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(raw, ' ')], ' ') END AS v FROM d),
l AS (SELECT code, arg_max(v, _rid) AS known FROM p WHERE v IS NOT NULL GROUP BY code),
q AS (SELECT _rid, coalesce(v, known) AS product, CAST(code AS VARCHAR) AS code FROM p LEFT JOIN l USING (code))
"""


def _products(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey AS _rid", f"{PRODUCT} AS product", f"{CODE} AS code")
    return apply_rules(df, [og.product_rules("product", "code", variants=False)])


@query("clean_product", _PRODUCT + "SELECT _rid, product, code, CASE WHEN product IS NULL THEN 'PROD-05' ELSE '' END AS flags FROM q")
def clean_product(spark, sf):
    return _products(spark, sf).annotated


@query("flags_product_code_conflict", _PRODUCT + """
SELECT _rid, code AS value FROM q WHERE code IN (SELECT code FROM q GROUP BY code HAVING count(DISTINCT product) > 1)""")
def flags_product_code_conflict(spark, sf):
    return _products(spark, sf).flags.filter("rule = 'PROD-04'").select("_rid", "value")


VARIANT = "CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's' ELSE p_name END"


@query("variant_groups_product")
def variant_groups_product(spark, sf):
    return variant_groups(dirty(spark, sf, VARIANT, "product", "part", "p_partkey"), "product", 0.8)


@query("variant_merge_product")
def variant_merge_product(spark, sf):
    df = dirty(spark, sf, VARIANT, "product", "part", "p_partkey")
    return apply_rules(df, [og.product_rules("product")]).table.groupBy("product").agg(F.count("*").alias("n"))


SKU = """CASE p_partkey % 7 WHEN 0 THEN '4006381333931' WHEN 1 THEN '4006381333932' WHEN 2 THEN '036000291452' WHEN 3 THEN '96385074' WHEN 4 THEN 'ab-12#' WHEN 5 THEN NULL
 ELSE 'sku ' || CAST(p_partkey % 50 AS VARCHAR(9)) END"""
_SKU = f"""
WITH d AS (SELECT p_partkey AS _rid, p_partkey % 7 AS k, p_name, {SKU} AS raw FROM part),
p AS (SELECT *, nullif(regexp_replace(upper(raw), '[^A-Z0-9-]', '', 'g'), '') AS sku FROM d)
"""


@query("clean_sku", _SKU + "SELECT _rid, sku, CASE WHEN k = 1 THEN 'SKU-04' ELSE '' END AS flags FROM p")
def clean_sku(spark, sf):
    return apply_rules(dirty(spark, sf, SKU, "sku", "part", "p_partkey"), [og.sku_rules("sku")]).annotated


@query("flags_sku_conflict", _SKU + "SELECT _rid, sku AS value FROM p WHERE sku IN (SELECT sku FROM p GROUP BY sku HAVING count(DISTINCT p_name) > 1)")
def flags_sku_conflict(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey AS _rid", f"{SKU} AS sku", "p_name")
    return apply_rules(df, [og.sku_rules("sku", "p_name")]).flags.filter("rule = 'SKU-02'").select("_rid", "value")


ORG = """CASE s_suppkey % 8 WHEN 0 THEN 'acme holdings pvt ltd' WHEN 1 THEN 'Globex INCORPORATED' WHEN 2 THEN 'ibm' WHEN 3 THEN 'un relief company' WHEN 4 THEN 'Who'
 WHEN 5 THEN NULL WHEN 6 THEN 'north sea p.l.c.' ELSE s_name END"""


@query("clean_organisation", """
SELECT s_suppkey AS _rid, CASE s_suppkey % 8 WHEN 0 THEN 'Acme Holdings Pvt. Ltd.' WHEN 1 THEN 'Globex Inc.' WHEN 2 THEN 'International Business Machines'
 WHEN 3 THEN 'UN Relief Co.' WHEN 4 THEN 'World Health Organization' WHEN 5 THEN NULL WHEN 6 THEN 'North Sea PLC' ELSE upper(s_name[1]) || lower(s_name[2:]) END AS org FROM supplier""")
def clean_organisation(spark, sf):
    return apply_rules(dirty(spark, sf, ORG, "org", "supplier", "s_suppkey"), [og.org_rules("org", variants=False)]).table


@query("variant_groups_organisation")
def variant_groups_organisation(spark, sf):
    return variant_groups(dirty(spark, sf, ORG, "org", "supplier", "s_suppkey"), "org", 0.85)


JOB = """CASE s_suppkey % 7 WHEN 0 THEN 'sr dev' WHEN 1 THEN 'VP sales' WHEN 2 THEN 'asst. mgr' WHEN 3 THEN 'nurse' WHEN 4 THEN 'chief accountant' WHEN 5 THEN NULL ELSE 'intern' END"""


@query("clean_job", """
WITH d AS (SELECT s_suppkey AS _rid, s_suppkey % 7 AS k FROM supplier)
SELECT _rid, ['Senior Developer', 'Vice President Sales', 'Assistant Manager', 'Nurse', 'Chief Accountant', NULL, 'Intern'][k + 1] AS title, 'Finance and IT' AS dept,
 ['Senior', 'Vice President', 'Assistant', NULL, 'Chief', NULL, 'Intern'][k + 1] AS title_seniority, [6, 7, 1, NULL, 10, NULL, 0][k + 1] AS title_level,
 CASE WHEN k IN (0, 3, 4) THEN 'JOB-05' ELSE '' END AS flags FROM d""")
def clean_job(spark, sf):
    df = table(spark, sf, "supplier").selectExpr("s_suppkey AS _rid", f"{JOB} AS title", "'Finance and IT' AS dept")
    return apply_rules(df, [og.job_rules("title", "dept", variants=False)]).annotated


@query("variant_merge_job", """
SELECT s_suppkey AS _rid, CASE s_suppkey % 3 WHEN 0 THEN 'Regional Managers' WHEN 1 THEN 'Regional Managers' ELSE 'Clerk' END AS title FROM supplier""")
def variant_merge_job(spark, sf):
    df = dirty(spark, sf, "CASE s_suppkey % 3 WHEN 0 THEN 'regional mgr' WHEN 1 THEN 'Regional managers' ELSE 'clerk' END", "title", "supplier", "s_suppkey")
    return apply_rules(df, [og.job_rules("title")]).table.select("_rid", "title")


DEPT = """CASE s_suppkey % 6 WHEN 0 THEN 'hr' WHEN 1 THEN 'r&d' WHEN 2 THEN 'operations > logistics' WHEN 3 THEN 'sales | emea' WHEN 4 THEN NULL ELSE 'IT helpdesk' END"""


@query("clean_department", """
WITH d AS (SELECT s_suppkey AS _rid, s_suppkey % 6 AS k FROM supplier)
SELECT _rid, ['Human Resources', 'Research and Development', 'Operations > Logistics', 'Sales | Emea', NULL, 'IT Helpdesk'][k + 1] AS dept,
 CASE k WHEN 2 THEN 'Operations' WHEN 3 THEN 'Sales' END AS dept_parent, CASE k WHEN 2 THEN 'Logistics' WHEN 3 THEN 'Emea' END AS dept_child FROM d""")
def clean_department(spark, sf):
    return apply_rules(dirty(spark, sf, DEPT, "dept", "supplier", "s_suppkey"), [og.department_rules("dept", variants=False)]).table


@query("variant_merge_department", """
SELECT s_suppkey AS _rid, CASE s_suppkey % 3 WHEN 2 THEN 'Legal' ELSE 'Purchasings' END AS dept FROM supplier""")
def variant_merge_department(spark, sf):
    df = dirty(spark, sf, "CASE s_suppkey % 3 WHEN 0 THEN 'purchasing' WHEN 1 THEN 'Purchasings' ELSE 'legal' END", "dept", "supplier", "s_suppkey")
    return apply_rules(df, [og.department_rules("dept")]).table.select("_rid", "dept")


REF = """CASE WHEN o_orderkey % 1000 = 1 THEN 'XX-9' WHEN o_orderkey % 1000 = 2 THEN NULL WHEN o_orderkey % 500 = 3 THEN 'INV-3' WHEN o_orderkey % 300 = 4 THEN NULL
 ELSE 'INV-' || CAST(o_orderkey AS VARCHAR(20)) END"""
_REF = f"WITH d AS (SELECT o_orderkey AS _rid, {REF} AS ref FROM orders)"


@query("clean_reference", _REF + " SELECT _rid, ref, CASE WHEN ref = 'XX-9' THEN 'REFNO-02' ELSE '' END AS flags FROM d")
def clean_reference(spark, sf):
    return apply_rules(dirty(spark, sf, REF, "ref", "orders", "o_orderkey"), [og.reference_rules("ref")]).annotated


@query("flags_repeated_reference", _REF + " SELECT _rid, ref AS value FROM d WHERE ref IN (SELECT ref FROM d GROUP BY ref HAVING count(*) > 1)")
def flags_repeated_reference(spark, sf):
    return apply_rules(dirty(spark, sf, REF, "ref", "orders", "o_orderkey"), [og.reference_rules("ref")]).flags.filter("rule = 'REFNO-01'").select("_rid", "value")


@query("reference_gaps", _REF + """,
u AS (SELECT DISTINCT CAST(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT) AS r FROM d WHERE ref IS NOT NULL), n AS (SELECT r, lag(r) OVER (ORDER BY r) AS before FROM u)
SELECT before + 1 AS gap_start, r - 1 AS gap_end FROM n WHERE r - before > 1""")
def reference_gaps(spark, sf):
    return og.reference_gaps(dirty(spark, sf, REF, "ref", "orders", "o_orderkey"), "ref")


@query("notes_reference", _REF + """
SELECT 'REFNO-05' AS rule, count(*) FILTER (ref IS NULL) || ' missing, next number ' || (max(CAST(regexp_extract(ref, '([0-9]+)$', 1) AS BIGINT)) + 1) AS value FROM d""")
def notes_reference(spark, sf):
    return apply_rules(dirty(spark, sf, REF, "ref", "orders", "o_orderkey"), [og.reference_rules("ref")]).flags.filter("rule = 'REFNO-05'").select("rule", "value")


VERSION = "CASE p_partkey % 7 WHEN 0 THEN 'V1.2.3' WHEN 1 THEN '2.10' WHEN 2 THEN 'release 3' WHEN 3 THEN 'r4' WHEN 4 THEN 'latest' WHEN 5 THEN NULL ELSE 'ver. 1.0.0' END"


@query("clean_version", """
WITH d AS (SELECT p_partkey AS _rid, p_partkey % 7 AS k FROM part)
SELECT _rid, ['v1.2.3', 'v2.10', 'v3.0', 'v4.0', 'latest', NULL, 'v1.0'][k + 1] AS ver,
 ['1.2.3', '2.10.0', '3.0.0', '4.0.0', NULL, NULL, '1.0.0'][k + 1] AS sort_key, CASE WHEN k = 4 THEN 'VER-02' ELSE '' END AS flags FROM d""")
def clean_version(spark, sf):
    out = apply_rules(dirty(spark, sf, VERSION, "ver", "part", "p_partkey"), [og.version_rules("ver")]).annotated
    key = F.when(F.col("ver_sort_key").isNotNull(), F.array_join(F.transform("ver_sort_key", lambda x: x.cast("string")), "."))
    return out.select("_rid", "ver", key.alias("sort_key"), "flags")
