from pyspark.sql import functions as F

from tidymill.operators import missing as mv
from tidymill.operators import validation as va
from . import query, table

AS_OF = "2000-06-30"
_CASES = """o_orderkey AS _rid, o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'Completed' WHEN 1 THEN 'paid' WHEN 2 THEN 'open' ELSE NULL END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE '2000-01-0' || CAST(1 + o_orderkey % 9 AS VARCHAR(2)) END AS closed_date, CASE WHEN o_orderkey % 5 = 0 THEN '-1' WHEN o_orderkey % 5 = 1 THEN 'x' ELSE '12.5' END AS amount,
 '2000-01-05' AS order_date, CASE WHEN o_orderkey % 7 = 0 THEN '1999-12-31' ELSE '2000-02-01' END AS ship_date, CASE WHEN o_orderkey % 6 = 0 THEN '20' ELSE '30' END AS age, '1970-05-01' AS dob,
 CAST(o_orderkey % 100 AS VARCHAR(5)) AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'Pass' ELSE 'fail' END AS result, CASE WHEN o_orderkey % 3 = 1 THEN 'Mr.' ELSE 'Mrs' END AS title,
 CASE WHEN o_orderkey % 2 = 1 THEN 'female' ELSE 'M' END AS gender, CASE WHEN o_orderkey % 2 = 1 THEN 'Australia' ELSE 'usa' END AS country, CASE WHEN o_orderkey % 3 = 1 THEN '+61 2 1234' ELSE '0012125551234' END AS phone,
 CAST(o_orderkey % 5 - 2 AS VARCHAR(5)) AS qty, '2000-01-01' AS admitted, CASE WHEN o_orderkey % 8 = 0 THEN '2000-03-01' WHEN o_orderkey % 8 = 1 THEN '2020-01-01' ELSE '2004-01-01' END AS graduated,
 CASE WHEN o_orderkey % 9 = 0 THEN '10' ELSE '3.01' END AS total, '1' AS p1, '2' AS p2"""
BIND = {"status": "status", "completed_date": "closed_date", "paid_amount": "amount", "dates": ["order_date", "ship_date"], "age": "age", "birth_date": "dob", "score": "score", "result": "result",
        "title": "title", "gender": "gender", "country": "country", "phone": "phone", "quantity": "qty", "amount": "amount", "admitted": "admitted", "graduated": "graduated", "total": "total", "parts": ["p1", "p2"]}
_SQL_CONDS = {
    "COND-01": "lower(status) = 'completed' AND closed_date IS NULL", "COND-02": "status = 'paid' AND coalesce(TRY_CAST(amount AS DOUBLE), -1) <= 0", "COND-03": "CAST(order_date AS DATE) > CAST(ship_date AS DATE)",
    "COND-05": "abs(CAST(age AS INT) - datesub('year', CAST(dob AS DATE), DATE '2000-06-30')) > 1", "COND-06": "(CAST(score AS INT) >= 40 AND result = 'fail') OR (CAST(score AS INT) < 40 AND result = 'Pass')",
    "COND-07": "(title = 'Mr.') <> (gender = 'M')", "COND-08": "CASE WHEN country = 'usa' THEN phone LIKE '+61%' ELSE phone LIKE '001%' END", "COND-09": "sign(CAST(qty AS DOUBLE)) * sign(TRY_CAST(amount AS DOUBLE)) < 0",
    "COND-10": "datediff('day', CAST(admitted AS DATE), CAST(graduated AS DATE)) / 365.25 NOT BETWEEN 1 AND 10", "COND-11": "abs(CAST(total AS DOUBLE) - 3) > 0.01 * greatest(abs(CAST(total AS DOUBLE)), 1)"}
_COLS = {"COND-01": "status", "COND-02": "status", "COND-03": "order_date", "COND-05": "age", "COND-06": "score", "COND-07": "title", "COND-08": "country", "COND-09": "qty", "COND-10": "admitted", "COND-11": "total"}


def cases(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_cases")
    return spark.sql(f"SELECT {_CASES} FROM orders_cases")


@query("validate_rules", f"WITH d AS (SELECT {_CASES} FROM orders)\n" + "\nUNION ALL ".join(
    f"SELECT '{r}' AS rule, '{_COLS[r]}' AS \"column\", _rid, {_COLS[r]} AS value FROM d WHERE {c}" for r, c in _SQL_CONDS.items()))
def validate_rules(spark, sf):
    return va.violations(cases(spark, sf), BIND, as_of=AS_OF)


@query("validate_summary", f"WITH d AS (SELECT {_CASES} FROM orders)\n" + "\nUNION ALL ".join(
    f"SELECT '{r}' AS rule, count(*) FILTER ({c}) AS n_violations, count(*) FILTER ({c}) = 0 AS passed FROM d" for r, c in _SQL_CONDS.items()))
def validate_summary(spark, sf):
    return va.check_summary(cases(spark, sf), BIND, AS_OF)


@query("referential_integrity", """
WITH d AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS cust FROM orders)
SELECT 'COND-04' AS rule, 'cust' AS "column", _rid, CAST(cust AS VARCHAR) AS value FROM d WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = cust)""")
def referential_integrity(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS cust")
    return va.violations(df, {}, {"cust": (table(spark, sf, "customer"), "c_custkey")})


@query("contradictory_status", """
WITH d AS (SELECT o_orderkey AS _rid, o_custkey AS id, CASE o_orderkey % 50 WHEN 0 THEN 'Active' WHEN 1 THEN 'closed' ELSE 'other' END AS st FROM orders)
SELECT _rid, CAST(id AS VARCHAR) AS value FROM d WHERE id IN (SELECT id FROM d GROUP BY id HAVING bool_or(st = 'Active') AND bool_or(st = 'closed'))""")
def contradictory_status(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "o_custkey AS id", "CASE o_orderkey % 50 WHEN 0 THEN 'Active' WHEN 1 THEN 'closed' ELSE 'other' END AS st")
    return va.contradictory_status(df, "id", "st")


_GAPS = """o_orderkey AS _rid, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 40 END AS age, '1980-0' || CAST(1 + o_orderkey % 9 AS VARCHAR(2)) || '-15' AS dob, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'Given Name' END AS full_name,
 'Ann' AS first, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Lee' END AS last, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1.5 END AS amount, o_orderkey % 7 AS qty, 2.25 AS price,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 3 END AS days, '2000-01-01' AS d1, '2000-01-1' || CAST(o_orderkey % 9 AS VARCHAR(2)) AS d2, CASE WHEN o_orderkey % 2 = 1 THEN NULL ELSE 'India' END AS country,
 CASE WHEN o_orderkey % 3 = 1 THEN 'Tokyo' ELSE 'Nowhere' END AS city, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 1999 END AS fy, CASE WHEN o_orderkey % 10 = 0 THEN 'private' ELSE 'Other' END AS gender,
 CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 55.5 END AS pct, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 7.0 END AS gpa, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 8 END AS s1, 6 AS s2"""
MV_BIND = {"age": "age", "birth_date": "dob", "full_name": "full_name", "name_parts": ["first", "last"], "amount": "amount", "quantity": "qty", "price": "price", "duration": "days", "start": "d1", "end": "d2",
           "country": "country", "city": "city", "fiscal_year": "fy", "date": "d1", "gender": "gender", "percent": "pct", "numerator": "qty", "denominator": "price", "grade_average": "gpa", "scores": ["s1", "s2"]}


def gaps(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders_gaps")
    sql = _GAPS.replace("2.25 AS price", "2.25D AS price").replace("ELSE 1.5 END", "ELSE 1.5D END").replace("ELSE 55.5 END", "ELSE 55.5D END").replace("ELSE 7.0 END", "ELSE 7.0D END")
    return spark.sql(f"SELECT {sql} FROM orders_gaps")


_FILLED = f"""
WITH d AS (SELECT {_GAPS} FROM orders),
f AS (SELECT _rid, coalesce(age, datesub('year', CAST(dob AS DATE), DATE '{AS_OF}')) AS age, CASE WHEN full_name = ' ' THEN concat_ws(' ', first, last) ELSE full_name END AS full_name,
 coalesce(amount, round(qty * price, 2)) AS amount, coalesce(days, datediff('day', CAST(d1 AS DATE), CAST(d2 AS DATE))) AS days, coalesce(country, CASE WHEN city = 'Tokyo' THEN 'Japan' END) AS country,
 coalesce(fy, 1999) AS fy, CASE WHEN gender = 'private' THEN 'Prefer Not to Say' ELSE gender END AS gender, coalesce(pct, round(qty / price * 100, 2)) AS pct,
 coalesce(gpa, round(CASE WHEN s1 IS NULL THEN 6 ELSE 7 END, 2)) AS gpa,
 concat_ws(',', CASE WHEN age IS NULL THEN 'MV-AGE' END, CASE WHEN full_name = ' ' THEN 'MV-NAME' END, CASE WHEN amount IS NULL THEN 'MV-AMOUNT' END, CASE WHEN pct IS NULL THEN 'MV-PCT' END,
  CASE WHEN days IS NULL THEN 'MV-DUR' END, CASE WHEN country IS NULL AND city = 'Tokyo' THEN 'MV-COUNTRY' END, CASE WHEN fy IS NULL THEN 'MV-FY' END, CASE WHEN gpa IS NULL THEN 'MV-GPA' END,
  CASE WHEN gender = 'private' THEN 'MV-GENDER' END) AS filled FROM d)
"""


@query("resolve_missing", _FILLED + "SELECT * FROM f")
def resolve_missing(spark, sf):
    out = mv.resolve_missing(gaps(spark, sf), MV_BIND, AS_OF, fiscal_start=4)
    return out.select("_rid", "age", "full_name", F.col("amount").cast("double").alias("amount"), "days", "country", "fy", "gender", F.col("pct").cast("double").alias("pct"), F.col("gpa").cast("double").alias("gpa"), "filled")


@query("missing_scenarios", _FILLED + "SELECT unnest(string_split(filled, ',')) AS scenario, count(*) AS n FROM f WHERE filled <> '' GROUP BY 1")
def missing_scenarios(spark, sf):
    return mv.scenario_counts(mv.resolve_missing(gaps(spark, sf), MV_BIND, AS_OF, fiscal_start=4))


@query("missing_summary", _FILLED + """
SELECT 'age' AS "column", (SELECT count(*) FILTER (age IS NULL) FROM d) AS missing, (SELECT count(*) FILTER (age IS NULL) FROM d) AS filled, 0 AS remaining
UNION ALL SELECT 'country', (SELECT count(*) FILTER (country IS NULL) FROM d), (SELECT count(*) FILTER (country IS NULL AND city = 'Tokyo') FROM d), (SELECT count(*) FILTER (country IS NULL AND city <> 'Tokyo') FROM d)""")
def missing_summary(spark, sf):
    df = gaps(spark, sf)
    return mv.summary(mv.resolve_missing(df, MV_BIND, AS_OF, fiscal_start=4), mv.missing_counts(df, ["age", "country"]), ["age", "country"])


@query("missing_prompts", "SELECT o_orderkey AS _rid, 'country' AS \"column\" FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 1")
def missing_prompts(spark, sf):
    return mv.prompts(mv.resolve_missing(gaps(spark, sf), MV_BIND, AS_OF, fiscal_start=4), ["country", "age"])


@query("missing_city", "SELECT c_custkey AS _rid, CASE WHEN c_custkey % 2 = 0 THEN 'Springfield' END AS city_suggestion FROM customer")
def missing_city(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "CASE WHEN c_custkey % 2 = 1 THEN 'Known' END AS city", "'1 Main St, Springfield, USA' AS address")
    return mv.city_from_address(df, "address", "city").select("_rid", "city_suggestion")


@query("missing_between_neighbours", """
WITH d AS (SELECT o_orderkey AS _rid, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders),
n AS (SELECT *, last_value(price IGNORE NULLS) OVER a AS p, first_value(price IGNORE NULLS) OVER b AS q, last_value(day IGNORE NULLS) OVER a AS s, first_value(day IGNORE NULLS) OVER b AS t FROM d
 WINDOW a AS (ORDER BY _rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (ORDER BY _rid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT _rid, CASE WHEN price IS NULL THEN round((p + q) / 2, 4) END AS price_suggestion,
 CASE WHEN day IS NULL THEN strftime(s + CAST(floor(datediff('day', s, t) / 2) AS INT), '%Y-%m-%d') END AS day_suggestion FROM n""")
def missing_between_neighbours(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS _rid", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
                                               "CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day")
    out = mv.between_neighbours(df, ["_rid"], ["price", "day"])
    return out.select("_rid", F.round("price_suggestion", 4).alias("price_suggestion"), F.date_format("day_suggestion", "yyyy-MM-dd").alias("day_suggestion"))


@query("missing_next_id", """
SELECT c_custkey AS _rid, CASE WHEN c_custkey % 5 = 4 THEN 'EMP' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS id_suggestion FROM customer""")
def missing_next_id(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "CASE WHEN c_custkey % 5 <> 4 THEN concat('EMP', lpad(cast(c_custkey as string), 6, '0')) END AS id")
    return mv.next_in_sequence(df, ["_rid"], "id").select("_rid", "id_suggestion")
