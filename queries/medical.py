from pyspark.sql import functions as F

from tidymill.operators import medical as md
from tidymill.operators.rules import apply_rules
from tidymill.sources.reader import spread
from . import query, table
from .people import dirty

DIAG = """CASE c_custkey % 10 WHEN 0 THEN 'type ii disease of the heart' WHEN 1 THEN 'HTN' WHEN 2 THEN 'severe COPD, chronic' WHEN 3 THEN 'E11.9' WHEN 4 THEN 'E1X.99999'
 WHEN 5 THEN 'diabetis' WHEN 6 THEN NULL WHEN 7 THEN 'Asthma and UTI' WHEN 8 THEN ' ' ELSE 'Fracture' END"""


@query("clean_diagnosis", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 10 AS k FROM customer)
SELECT _rid, ['Type II Disease of the Heart', 'Hypertension', 'severe Chronic Obstructive Pulmonary Disease chronic', 'E11.9', 'E1X.99999', 'Diabetis', NULL,
  'Asthma and Urinary Tract Infection', ' ', 'Fracture'][k + 1] AS dx, CASE WHEN k = 5 THEN 'diabetes' END AS dx_suggestion,
 ['', '', '', '', 'DIAG-02', 'DIAG-04', 'DIAG-06', 'DIAG-07', 'DIAG-06', ''][k + 1] AS flags FROM d""")
def clean_diagnosis(spark, sf):
    return apply_rules(dirty(spark, sf, DIAG, "dx"), [md.diagnosis_rules("dx")]).annotated


@query("notes_diagnosis", "SELECT 'DIAG-05' AS rule, 'dx' AS \"column\"")
def notes_diagnosis(spark, sf):
    return apply_rules(dirty(spark, sf, DIAG, "dx"), [md.diagnosis_rules("dx")]).flags.filter("rule = 'DIAG-05'").select("rule", "column")


WEIGHT = "CASE c_custkey % 7 WHEN 0 THEN '65 kg' WHEN 1 THEN '150 lbs' WHEN 2 THEN '70.26' WHEN 3 THEN '10 stone' WHEN 4 THEN NULL WHEN 5 THEN '900' ELSE '45000 g' END"
HEIGHT = """CASE c_custkey % 6 WHEN 0 THEN '5' || chr(39) || '9"' WHEN 1 THEN '1.8 m' WHEN 2 THEN '170 cm' WHEN 3 THEN '6 ft' WHEN 4 THEN '20' ELSE '65 inches' END"""
TEMP = "CASE c_custkey % 5 WHEN 0 THEN '98.6°F' WHEN 1 THEN '37.04 C' WHEN 2 THEN '41' WHEN 3 THEN '99 F' ELSE '20' END"
BP = "CASE c_custkey % 4 WHEN 0 THEN '120/80' WHEN 1 THEN '300 / 80' WHEN 2 THEN NULL ELSE '110/20' END"


def _body(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS _rid", f"{WEIGHT} AS weight", f"{HEIGHT} AS height", f"{TEMP} AS temperature", f"{BP} AS bp")
    return apply_rules(spread(df, "_rid"), [md.measurement_rules(c) for c in ("weight", "height", "temperature", "bp")])


@query("clean_measurements", """
WITH d AS (SELECT c_custkey AS _rid, c_custkey % 7 AS w, c_custkey % 6 AS h, c_custkey % 5 AS t, c_custkey % 4 AS b FROM customer)
SELECT _rid, [65, 68, 70.3, 63.5, NULL, 900, 45][w + 1] AS weight, ['kg', 'lb', NULL, 'st', NULL, NULL, 'g'][w + 1] AS weight_unit,
 [175.3, 180, 170, 182.9, 20, 165.1][h + 1] AS height, ['in', 'm', 'cm', 'ft', NULL, 'in'][h + 1] AS height_unit,
 [37, 37, 41, 37.2, 20][t + 1] AS temperature, ['F', 'C', NULL, 'F', NULL][t + 1] AS temperature_unit,
 ['120/80', '300 / 80', NULL, '110/20'][b + 1] AS bp, CASE WHEN b <> 2 THEN 'mmHg' END AS bp_unit,
 concat_ws(',', CASE WHEN w = 4 THEN 'PHYS-08' END, CASE WHEN b = 2 THEN 'PHYS-08' END, CASE WHEN b IN (1, 3) THEN 'PHYS-04' END, CASE WHEN w = 5 THEN 'PHYS-04' END, CASE WHEN h = 4 THEN 'PHYS-04' END,
  CASE WHEN t = 4 THEN 'PHYS-04' END) AS flags FROM d""")
def clean_measurements(spark, sf):
    return _body(spark, sf).annotated


@query("body_mass_index", """
WITH d AS (SELECT c_custkey AS _rid, [65, 68, 70.3, 63.5, NULL, 900, 45][c_custkey % 7 + 1] AS w, [175.3, 180, 170, 182.9, 20, 165.1][c_custkey % 6 + 1] AS h FROM customer),
b AS (SELECT _rid, w / power(h / 100, 2) AS x FROM d), r AS (SELECT _rid, CASE WHEN x BETWEEN 10 AND 80 THEN round(x, 1) END AS bmi FROM b)
SELECT _rid, bmi, CASE WHEN bmi < 18.5 THEN 'Underweight' WHEN bmi < 25 THEN 'Normal' WHEN bmi < 30 THEN 'Overweight' WHEN bmi IS NOT NULL THEN 'Obese' END AS bmi_category FROM r""")
def body_mass_index(spark, sf):
    return md.add_bmi(_body(spark, sf).table, "weight", "height").select("_rid", "bmi", "bmi_category")
