from pyspark.sql import functions as F

from tidymill.operators import contact as ct
from tidymill.operators.rules import apply_rules
from . import query, table
from .people import dirty

PHONE = """CASE c_custkey % 11 WHEN 0 THEN '+1 (555) 010-' || CAST(1000 + c_custkey % 9000 AS VARCHAR(9)) WHEN 1 THEN '0000000000'
 WHEN 2 THEN '+44 7911 12345' || CAST(c_custkey % 9 AS VARCHAR(9)) WHEN 3 THEN '555-2368 ext. 42' WHEN 4 THEN '+977 9841' || CAST(100000 + c_custkey AS VARCHAR(9))
 WHEN 5 THEN '+91 9812345678 / 022-5551234' WHEN 6 THEN NULL WHEN 7 THEN '77777777' WHEN 8 THEN 'n/a' WHEN 9 THEN '12345' ELSE '+49 30 1234567' END"""
_PHONE = f"""
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 11 AS k, {PHONE} AS raw FROM customer),
p AS (SELECT *, CASE WHEN k IN (1, 6, 7, 8) THEN NULL WHEN k = 3 THEN '+15552368' WHEN k = 5 THEN '+919812345678' WHEN k = 9 THEN '+12345'
   ELSE '+' || regexp_replace(raw, '[^0-9]', '', 'g') END AS phone FROM d)
"""


@query("clean_phone", _PHONE + """
SELECT _rid, phone, CASE WHEN k = 5 THEN '+91 9812345678' END AS phone_primary, CASE WHEN k = 5 THEN '022-5551234' END AS phone_secondary,
 CASE WHEN k = 3 THEN '42' END AS phone_extension, CASE WHEN k IN (2, 4, 5) THEN 'Mobile' WHEN k = 10 THEN 'Landline' END AS phone_type,
 concat_ws(',', CASE WHEN k IN (3, 9, 10) THEN 'PHONE-05' END, CASE WHEN phone IS NULL THEN 'PHONE-10' END) AS flags FROM p""")
def clean_phone(spark, sf):
    return apply_rules(dirty(spark, sf, PHONE, "phone"), [ct.phone_rules("phone")]).annotated


@query("flags_shared_phone", _PHONE + """
SELECT _rid, phone AS value FROM p WHERE phone IN (SELECT phone FROM p GROUP BY phone HAVING count(DISTINCT _rid % 50) > 1)""")
def flags_shared_phone(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "c_custkey % 50 AS owner", f"{PHONE} AS phone")
    res = apply_rules(df, [ct.phone_rules("phone", id_column="owner")])
    return res.flags.filter("rule = 'PHONE-06'").select("_rid", "value")


EMAIL = """CASE c_custkey % 9 WHEN 0 THEN ' User' || CAST(c_custkey % 40 AS VARCHAR(9)) || '@GMAIL.com ' WHEN 1 THEN 'test@test.com'
 WHEN 2 THEN 'joe@gmial.com' WHEN 3 THEN 'x@mailinator.com' WHEN 4 THEN 'a' || CAST(c_custkey AS VARCHAR(9)) || '@b.org; c@d.net'
 WHEN 5 THEN 'no-at-sign' WHEN 6 THEN NULL WHEN 7 THEN 'q@site.c' ELSE 'k@corp.example.com' END"""
_EMAIL = f"""
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 9 AS k, {EMAIL} AS raw FROM customer),
p AS (SELECT *, CASE WHEN k IN (1, 6) THEN NULL WHEN k = 4 THEN split_part(raw, ';', 1) ELSE lower(trim(raw)) END AS email FROM d)
"""


@query("clean_email", _EMAIL + """
SELECT _rid, email, CASE WHEN k = 4 THEN 'c@d.net' END AS email_secondary, CASE WHEN k = 2 THEN 'joe@gmail.com' END AS email_suggestion,
 concat_ws(',', CASE WHEN NOT regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}') THEN 'EMAIL-02' END,
  CASE WHEN k = 7 THEN 'EMAIL-03' END, CASE WHEN k = 3 THEN 'EMAIL-05' END, CASE WHEN email IS NULL THEN 'EMAIL-08' END,
  CASE WHEN k = 2 THEN 'EMAIL-10' END) AS flags FROM p""")
def clean_email(spark, sf):
    return apply_rules(dirty(spark, sf, EMAIL, "email"), [ct.email_rules("email")]).annotated


@query("flags_repeated_email", _EMAIL + "SELECT _rid, email AS value FROM p WHERE email IN (SELECT email FROM p GROUP BY email HAVING count(*) > 1)")
def flags_repeated_email(spark, sf):
    return apply_rules(dirty(spark, sf, EMAIL, "email"), [ct.email_rules("email")]).flags.filter("rule = 'EMAIL-04'").select("_rid", "value")


@query("audit_email", _EMAIL + """,
c AS (SELECT raw, email, k, CASE WHEN k = 4 THEN split_part(raw, ';', 1) ELSE raw END AS e9, CASE WHEN k = 4 THEN split_part(raw, ';', 1) ELSE trim(raw) END AS e6 FROM p)
SELECT rule, n FROM (
 SELECT 'EMAIL-09' AS rule, count(*) FILTER (e9 IS DISTINCT FROM raw) AS n FROM c
 UNION ALL SELECT 'EMAIL-06', count(*) FILTER (e6 IS DISTINCT FROM e9) FROM c
 UNION ALL SELECT 'EMAIL-07', count(*) FILTER (k = 1) FROM c
 UNION ALL SELECT 'EMAIL-01', count(*) FILTER (k <> 1 AND email IS DISTINCT FROM e6) FROM c) WHERE n > 0""")
def audit_email(spark, sf):
    return apply_rules(dirty(spark, sf, EMAIL, "email"), [ct.email_rules("email")]).audit.groupBy("rule").agg(F.count("*").alias("n"))


ADDRESS = """CASE c_custkey % 6 WHEN 0 THEN '12  main st.' || chr(10) || 'apt 4, springfield' WHEN 1 THEN 'n/a' WHEN 2 THEN 'P.O. Box 77'
 WHEN 3 THEN 'NW 5th ave' WHEN 4 THEN '' ELSE '9 oak blvd bldg C' END"""


@query("clean_address", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 6 AS k FROM customer)
SELECT _rid, ['12 Main Street Apartment 4, Springfield', NULL, 'P.O. Box 77', 'NW 5Th Avenue', '', '9 Oak Boulevard Building C'][k + 1] AS addr,
 CASE WHEN k IN (1, 4) THEN 'ADDR-06' WHEN k = 2 THEN 'ADDR-07' ELSE '' END AS flags FROM d""")
def clean_address(spark, sf):
    return apply_rules(dirty(spark, sf, ADDRESS, "addr"), [ct.address_rules("addr")]).annotated


@query("address_parts", """
SELECT c_custkey AS _rid, CASE WHEN c_custkey % 2 = 0 THEN '1 High Street' ELSE 'Flat 2' END AS a_part1,
 CASE WHEN c_custkey % 2 = 0 THEN 'Leeds' END AS a_part2, CAST(NULL AS VARCHAR) AS a_part3 FROM customer""")
def address_parts(spark, sf):
    df = dirty(spark, sf, "CASE WHEN c_custkey % 2 = 0 THEN '1 High Street, Leeds' ELSE 'Flat 2' END", "a")
    return ct.address_parts(df, "a").drop("a")


CITY = """CASE WHEN c_custkey = 5 THEN 'londn' WHEN c_custkey = 16 THEN 'Pariss' WHEN c_custkey = 17 THEN 'Ulaanbaatar'
 WHEN c_custkey % 5 = 0 THEN 'nyc' WHEN c_custkey % 5 = 1 THEN 'london' WHEN c_custkey % 5 = 2 THEN 'PARIS' WHEN c_custkey % 5 = 3 THEN 'new-delhi' ELSE NULL END"""
_CITY = f"""
WITH d AS (SELECT c_custkey AS _rid, {CITY} AS raw FROM customer),
p AS (SELECT *, CASE raw WHEN 'nyc' THEN 'New York City' WHEN 'london' THEN 'London' WHEN 'PARIS' THEN 'Paris' WHEN 'new-delhi' THEN 'New-Delhi'
  WHEN 'londn' THEN 'Londn' ELSE raw END AS city FROM d)
"""


@query("clean_city", _CITY + "SELECT _rid, city, 'somewhere' AS addr, CASE WHEN city IS NULL THEN 'CITY-06' ELSE '' END AS flags FROM p")
def clean_city(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", f"{CITY} AS city", "'somewhere' AS addr")
    return apply_rules(df, [ct.city_rules("city", "addr")]).annotated


@query("flags_misspelt_city", _CITY + """,
u AS (SELECT lower(city) AS v, count(*) AS n FROM p WHERE city IS NOT NULL GROUP BY 1)
SELECT _rid, lower(city) AS value FROM p WHERE lower(city) IN
 (SELECT a.v FROM u a, u b WHERE a.n = 1 AND b.n > 1 AND levenshtein(a.v, b.v) <= 2)""")
def flags_misspelt_city(spark, sf):
    return apply_rules(dirty(spark, sf, CITY, "city"), [ct.city_rules("city")]).flags.filter("rule = 'CITY-02'").select("_rid", "value")


COUNTRY = """CASE c_custkey % 9 WHEN 0 THEN 'usa' WHEN 1 THEN 'DEU' WHEN 2 THEN 'np' WHEN 3 THEN 'Grmany' WHEN 4 THEN 'atlantis' WHEN 5 THEN NULL
 WHEN 6 THEN 'england' ELSE 'SOUTH KOREA' END"""


@query("clean_country", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 9 AS k FROM customer)
SELECT _rid, ['United States', 'Germany', 'Nepal', 'Grmany', 'Atlantis', NULL, 'United Kingdom', 'South Korea', 'South Korea'][k + 1] AS country,
 CASE k WHEN 3 THEN 'CNTRY-02' WHEN 4 THEN 'CNTRY-05' ELSE '' END AS flags FROM d""")
def clean_country(spark, sf):
    return apply_rules(dirty(spark, sf, COUNTRY, "country"), [ct.country_rules("country")]).annotated


@query("country_iso3", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 9 AS k FROM customer)
SELECT _rid, ['USA', 'DEU', 'NPL', 'Grmany', 'atlantis', NULL, 'GBR', 'KOR', 'KOR'][k + 1] AS country FROM d""")
def country_iso3(spark, sf):
    return apply_rules(dirty(spark, sf, COUNTRY, "country"), [ct.country_rules("country", "iso3")]).table


@query("suggest_country", """
WITH d AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'Nepal' ELSE 'India' END AS v FROM customer)
SELECT 'India' AS suggestion, round(count(*) FILTER (v = 'India') / count(v) * 100, 1) AS share_pct, count(*) FILTER (v IS NULL) AS n_missing FROM d""")
def suggest_country(spark, sf):
    df = dirty(spark, sf, "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'Nepal' ELSE 'India' END", "v")
    return ct.dominant_value(df, "v")


POSTAL = """CASE c_custkey % 6 WHEN 0 THEN '501' WHEN 1 THEN '123456789' WHEN 2 THEN 'SW1A 1AA' WHEN 3 THEN '1234' WHEN 4 THEN '!!' ELSE NULL END"""
POSTAL_COUNTRY = "CASE c_custkey % 6 WHEN 2 THEN 'uk' WHEN 3 THEN 'Germany' WHEN 4 THEN NULL ELSE 'US' END"


@query("clean_postal", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 6 AS k FROM customer)
SELECT _rid, ['00501', '12345-6789', 'SW1A 1AA', '01234', '!!', NULL][k + 1] AS zip, ['US', 'US', 'uk', 'Germany', NULL, 'US'][k + 1] AS land,
 CASE WHEN k = 4 THEN 'POST-02' ELSE '' END AS flags FROM d""")
def clean_postal(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", f"{POSTAL} AS zip", f"{POSTAL_COUNTRY} AS land")
    return apply_rules(df, [ct.postal_rules("zip", "land")]).annotated


GEO = """CASE c_custkey % 6 WHEN 0 THEN '27°42' || chr(39) || '15"S' WHEN 1 THEN '85.123456789' WHEN 2 THEN '120.5' WHEN 3 THEN NULL WHEN 4 THEN 'north' ELSE '-12.5' END"""


@query("clean_coordinates", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 6 AS k FROM customer)
SELECT _rid, [-27.704167, 85.123457, 120.5, NULL, NULL, -12.5][k + 1] AS lat, '45.0' AS lon,
 [ '', '', 'GEO-01,GEO-06', 'GEO-05', 'GEO-01', ''][k + 1] AS flags FROM d""")
def clean_coordinates(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", f"{GEO} AS lat", "'45.0' AS lon")
    return apply_rules(df, [ct.coordinate_rules("lat", "lon")]).annotated
