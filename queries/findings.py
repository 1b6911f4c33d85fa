"""Findings about whole columns and rare flags, next to SQL that counts them."""
from pyspark.sql import functions as F

from tidymill.operators import categorical, contact, numeric, organisation, structure, text_columns
from tidymill.operators.rules import apply_rules
from . import query, table


def notes(spark, df, rules):
    """rule, column, text of the column findings."""
    return spark.createDataFrame([(rule, column, text) for rule, column, text in apply_rules(df, rules).column_notes], "rule string, `column` string, text string")


@query("notes_missing_values", """
SELECT rule, "column", n || ' missing' AS text FROM (
 SELECT 'CAT-06' AS rule, 'kind' AS "column", count(*) FILTER (c_custkey % 4 = 0) AS n FROM customer UNION ALL SELECT 'ORG-05', 'company', count(*) FILTER (c_custkey % 5 = 1) FROM customer
 UNION ALL SELECT 'DEPT-05', 'department', count(*) FILTER (c_custkey % 6 = 2) FROM customer UNION ALL SELECT 'VER-04', 'version', count(*) FILTER (c_custkey % 7 = 3) FROM customer
 UNION ALL SELECT 'IP-05', 'ip', count(*) FILTER (c_custkey % 8 = 4) FROM customer UNION ALL SELECT 'FILE-04', 'path', count(*) FILTER (c_custkey % 9 = 5) FROM customer) WHERE n > 0""")
def notes_missing_values(spark, sf):
    """How many values of a column are missing, for the formula sets that only note it."""
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS kind", "CASE WHEN c_custkey % 5 <> 1 THEN concat('Acme ', c_mktsegment) END AS company",
                                                 "CASE WHEN c_custkey % 6 <> 2 THEN c_mktsegment END AS department", "CASE WHEN c_custkey % 7 <> 3 THEN concat('v1.', c_custkey % 5) END AS version",
                                                 "CASE WHEN c_custkey % 8 <> 4 THEN concat('10.0.0.', c_custkey % 250) END AS ip", "CASE WHEN c_custkey % 9 <> 5 THEN concat('/data/', c_custkey, '.csv') END AS path")
    found = notes(spark, df, [categorical.category_rules("kind", typos=False), organisation.org_rules("company", variants=False), organisation.department_rules("department", variants=False),
                              organisation.version_rules("version"), text_columns.ip_rules("ip"), text_columns.path_rules("path")])
    return found.filter("rule in ('CAT-06', 'ORG-05', 'DEPT-05', 'VER-04', 'IP-05', 'FILE-04')")


@query("notes_score_scales", """
WITH s AS (SELECT 'grade' AS c, min(c_custkey % 4) AS lo, max(c_custkey % 4) AS hi FROM customer UNION ALL SELECT 'weighted', min((c_custkey % 51) / 10), max((c_custkey % 51) / 10) FROM customer
 UNION ALL SELECT 'marks', min(c_custkey % 11), max(c_custkey % 11) FROM customer UNION ALL SELECT 'share', min(c_custkey % 101), max(c_custkey % 101) FROM customer UNION ALL SELECT 'points', min(c_custkey % 500), max(c_custkey % 500) FROM customer)
SELECT 'SCORE-01' AS rule, c AS "column", 'scale ' || CASE WHEN lo < 0 THEN 'custom' WHEN hi <= 4 THEN 'gpa_4' WHEN hi <= 5 THEN 'gpa_5' WHEN hi <= 10 THEN 'scale_10' WHEN hi <= 100 THEN 'scale_100' ELSE 'custom' END AS text FROM s
UNION ALL SELECT 'SCORE-04', c, 'grade points above 4.0' FROM s WHERE hi > 4 AND hi <= 5""")
def notes_score_scales(spark, sf):
    """The scale that a column of scores fits, and weighted grade points."""
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "CAST(c_custkey % 4 AS STRING) AS grade", "CAST((c_custkey % 51) / 10 AS STRING) AS weighted", "CAST(c_custkey % 11 AS STRING) AS marks",
                                                 "CAST(c_custkey % 101 AS STRING) AS share", "CAST(c_custkey % 500 AS STRING) AS points")
    return notes(spark, df, [numeric.score_rules(c) for c in ("grade", "weighted", "marks", "share", "points")]).filter("rule in ('SCORE-01', 'SCORE-04')")


@query("notes_several_numbers", """
SELECT 'PHONE-01' AS rule, 'phone' AS "column", 'most rows hold several numbers' AS text FROM customer HAVING count(*) FILTER (c_custkey % 3 <> 0) >= 0.5 * count(*)""")
def notes_several_numbers(spark, sf):
    """A column of which most cells hold two numbers, beside one with single numbers."""
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "CASE WHEN c_custkey % 3 <> 0 THEN '+91 9812345678 / 022-5551234' ELSE '+91 9812345678' END AS phone", "'+91 9812345678' AS mobile")
    return notes(spark, df, [contact.phone_rules("phone"), contact.phone_rules("mobile")]).filter("rule = 'PHONE-01'")


@query("flags_postal_letters", """
SELECT c_custkey AS _rid, 'SW1A 1AA' AS value FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 IN (3, 4)""")
def flags_postal_letters(spark, sf):
    """Letters in a postal code, outside the countries whose codes have them."""
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "CASE WHEN c_custkey % 2 = 0 THEN 'SW1A 1AA' ELSE '44600' END AS postal_code",
                                                 "CASE c_custkey % 5 WHEN 0 THEN 'United Kingdom' WHEN 1 THEN 'Canada' WHEN 2 THEN 'Ireland' WHEN 3 THEN 'Germany' END AS country")
    return apply_rules(df, [contact.postal_rules("postal_code", "country")]).flags.filter("rule = 'POST-04'").select("_rid", "value")


@query("transposed_signals", """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (regexp_matches(r_name, '^[a-zA-Z][a-zA-Z0-9_]*$')) AS named, count(DISTINCT r_name) AS d FROM region)
SELECT 'turned' AS shape, CAST(31 > 5 * n AND n < 20 AS INT) + CAST(n >= 2 AND d >= n * 0.98 AND named >= 0.5 * n AS INT) + 1 AS signals FROM n
UNION ALL SELECT 'usual', CAST(3 > 5 * least(n, 20) AND n < 20 AS INT) FROM (SELECT count(*) AS n FROM customer)""")
def transposed_signals(spark, sf):
    """Signals that rows and columns are swapped: region names down the side with thirty numbered columns, and a usual table."""
    turned = table(spark, sf, "region").select(F.col("r_regionkey").alias("_rid"), F.col("r_name").alias("name"), *[(F.col("r_regionkey") * i).alias(str(i)) for i in range(1, 31)])
    usual = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", "c_nationkey % 3 AS nation", "c_name AS name", "c_acctbal AS balance")
    return spark.createDataFrame([(shape, structure.looks_transposed(df)) for shape, df in (("turned", turned), ("usual", usual))], "shape string, signals int")


FREQUENCY = "CASE event_id % 6 WHEN 0 THEN 'never' WHEN 1 THEN 'Rarely' WHEN 2 THEN ' sometimes' WHEN 3 THEN 'often' WHEN 4 THEN 'ALWAYS' END"


@query("survey_frequency", "SELECT event_id AS _rid, CASE WHEN event_id % 6 < 5 THEN CAST(event_id % 6 + 1 AS DOUBLE) END AS score FROM events")
def survey_frequency(spark, sf):
    """Answers of frequency, from never to always, as 1 to 5."""
    df = table(spark, sf, "events").selectExpr("event_id AS _rid", f"{FREQUENCY} AS q1")
    return apply_rules(df, [categorical.survey_rules("q1")]).table.select("_rid", F.col("q1_score").cast("double").alias("score"))


@query("notes_frequency_scale", """
SELECT unnest(['SURV-01', 'SURV-04']) AS rule, 'q1' AS "column", unnest(['scale frequency', 'answers of frequency, scored 1 to 5']) AS text FROM (SELECT count(*) AS n FROM events WHERE event_id % 6 < 5) WHERE n > 0""")
def notes_frequency_scale(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id AS _rid", f"{FREQUENCY} AS q1", "CAST(event_id % 5 + 1 AS STRING) AS q2")
    return notes(spark, df, [categorical.survey_rules("q1"), categorical.survey_rules("q2")]).filter("rule = 'SURV-04' OR (rule = 'SURV-01' AND column = 'q1')")
