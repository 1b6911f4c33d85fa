from pyspark.sql import functions as F

from tidymill.operators import identity as idt
from tidymill.operators.rules import apply_rules
from tidymill.sources.reader import spread
from . import query, table

# deterministic dirt, the same text in both engines
FULL_NAME = """CASE c_custkey % 10
 WHEN 0 THEN 'dr. john o' || chr(39) || 'brien' WHEN 1 THEN '  MARY   ANN  smith ' WHEN 2 THEN 'Mcdonald, ronald'
 WHEN 3 THEN 'n/a' WHEN 4 THEN 'James Wilson jr.' WHEN 5 THEN 'anna-maria lopez#' WHEN 6 THEN 'Madonna'
 WHEN 7 THEN 'J. D.' WHEN 8 THEN 'Prof Alan macarthur iii' ELSE 'user ' || CAST(c_custkey + 12345678 AS VARCHAR(20)) END"""

_CASE_WORD = """CASE WHEN contains(w, chr(39)) THEN array_to_string([upper(p[1]) || lower(p[2:]) for p in string_split(w, chr(39))], chr(39))
 WHEN contains(w, '-') THEN array_to_string([upper(p[1]) || lower(p[2:]) for p in string_split(w, '-')], '-')
 WHEN lower(w) LIKE 'mc%' AND length(w) > 2 THEN 'Mc' || upper(w[3]) || lower(w[4:])
 WHEN lower(w) LIKE 'mac%' AND length(w) > 3 THEN 'Mac' || upper(w[4]) || lower(w[5:])
 ELSE upper(w[1]) || lower(w[2:]) END"""

_NAME_SQL = f"""
WITH d AS (SELECT c_custkey AS _rid, {FULL_NAME} AS raw FROM customer),
a AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS v1 FROM d),
b AS (SELECT *, CASE WHEN lower(v1) NOT IN ('n/a') THEN v1 END AS v2 FROM a),
c AS (SELECT *, regexp_replace(v2, '^(?i)(mr|mrs|ms|dr|prof|sir)\\.*\\s+', '') AS v3 FROM b),
e AS (SELECT *, CASE WHEN contains(v3, ',') THEN trim(split_part(v3, ',', 2)) || ' ' || trim(split_part(v3, ',', 1)) ELSE v3 END AS v4 FROM c),
f AS (SELECT *, trim(regexp_replace(v4, '[^A-Za-z ''.-]', '', 'g')) AS v5 FROM e),
g AS (SELECT *, array_to_string([{_CASE_WORD} for w in string_split(v5, ' ')], ' ') AS v6 FROM f),
h AS (SELECT *, nullif(regexp_extract(v6, '^(?i)(.*\\S)\\s+((?:jr|sr|iii|ii)[.,]*)$', 2), '') AS suffix FROM g),
k AS (SELECT *, CASE WHEN suffix IS NULL THEN v6 ELSE regexp_extract(v6, '^(?i)(.*\\S)\\s+((?:jr|sr|iii|ii)[.,]*)$', 1) END AS v7 FROM h)
"""


def dirty(spark, sf, expr, column, source="customer", key="c_custkey"):
    return spread(table(spark, sf, source).selectExpr(f"{key} AS _rid", f"{expr} AS {column}"), "_rid")


@query("clean_full_name", _NAME_SQL + """
SELECT _rid, v7 AS full_name, suffix AS full_name_suffix,
 concat_ws(',', CASE WHEN length(regexp_replace(raw, '\\D', '', 'g')) > 0.3 * length(raw) THEN 'FNAME-05' END,
   CASE WHEN v7 <> '' AND NOT contains(v7, ' ') THEN 'FNAME-08' END,
   CASE WHEN regexp_matches(replace(trim(raw), ' ', ''), '^([A-Z]\\.)+$') THEN 'FNAME-09' END) AS flags FROM k""")
def clean_full_name(spark, sf):
    return apply_rules(dirty(spark, sf, FULL_NAME, "full_name"), [idt.full_name_rules("full_name", fuzzy=False)]).annotated


@query("flags_name_duplicates", _NAME_SQL + """
SELECT _rid, 'FNAME-07' AS rule FROM k WHERE lower(v7) IN (SELECT lower(v7) FROM k WHERE v7 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""")
def flags_name_duplicates(spark, sf):
    res = apply_rules(dirty(spark, sf, FULL_NAME, "full_name"), [idt.full_name_rules("full_name", fuzzy=False)])
    return res.flags.filter("rule = 'FNAME-07'").select("_rid", "rule")


NEAR_NAME = """CASE WHEN p_partkey % 9 = 0 THEN replace(p_name, 'i', 'y') WHEN p_partkey % 9 = 1 THEN p_name || 's'
 ELSE p_name END || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'Smith' WHEN 1 THEN 'Johnson' ELSE 'Okonkwo' END"""


@query("flags_similar_names", f"""
WITH d AS (SELECT p_partkey AS _rid, {NEAR_NAME} AS v FROM part),
u AS (SELECT DISTINCT v FROM d),
n AS (SELECT DISTINCT a.v FROM u a JOIN u b ON a.v <> b.v AND levenshtein(lower(a.v), lower(b.v)) <= 2)
SELECT _rid, v AS value FROM d WHERE v IN (SELECT v FROM n)""")
def flags_similar_names(spark, sf):
    from tidymill.operators.similarity import near_values, rows_with_value
    df = dirty(spark, sf, NEAR_NAME, "v", "part", "p_partkey")
    return rows_with_value(df, "v", near_values(df, "v"))


FIRST_NAME = """CASE c_custkey % 6 WHEN 0 THEN ' mr peter  ' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'mcgregor sr.'
 WHEN 3 THEN 'jean-luc' WHEN 4 THEN 'dr' ELSE 'sara' END"""


@query("clean_short_name", f"""
WITH d AS (SELECT c_custkey AS _rid, {FIRST_NAME} AS raw FROM customer),
a AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS v1 FROM d),
b AS (SELECT *, CASE WHEN lower(v1) NOT IN ('unknown') THEN v1 END AS v2 FROM a),
c AS (SELECT *, coalesce(nullif(regexp_replace(v2, '^(?i)(mr|dr)\\.*(\\s+|$)', ''), ''), v2) AS v3 FROM b),
g AS (SELECT *, array_to_string([{_CASE_WORD} for w in string_split(v3, ' ')], ' ') AS v6 FROM c),
h AS (SELECT *, nullif(regexp_extract(v6, '^(?i)(.*\\S)\\s+((?:jr|sr|iii|ii)[.,]*)$', 2), '') AS suffix FROM g)
SELECT _rid, CASE WHEN suffix IS NULL THEN v6 ELSE regexp_extract(v6, '^(?i)(.*\\S)\\s+((?:jr|sr)[.,]*)$', 1) END AS first_name,
       suffix AS first_name_suffix FROM h""")
def clean_short_name(spark, sf):
    return apply_rules(dirty(spark, sf, FIRST_NAME, "first_name"), [idt.short_name_rules("first_name")]).table


UID = """CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'C-' || CAST(c_custkey % 300 AS VARCHAR(10))
 WHEN c_custkey % 7 = 1 THEN 'C ' || CAST(c_custkey AS VARCHAR(10)) ELSE 'C_' || CAST(c_custkey AS VARCHAR(10)) END"""
_UID_SQL = f"""
WITH d AS (SELECT c_custkey AS _rid, regexp_replace({UID}, '[\\s_-]+', '', 'g') AS v FROM customer),
w AS (SELECT max(length(v) - 1) AS w FROM d),
k AS (SELECT _rid, 'C' || lpad(v[2:], CAST(w AS INT), '0') AS uid FROM d, w)
"""


@query("clean_uid", _UID_SQL + "SELECT _rid, uid, CASE WHEN uid IS NULL THEN 'UID-05' ELSE '' END AS flags FROM k")
def clean_uid(spark, sf):
    return apply_rules(dirty(spark, sf, UID, "uid"), [idt.uid_rules("uid")]).annotated


@query("flags_uid_repeated", _UID_SQL + """
SELECT _rid, uid AS value FROM k WHERE uid IN (SELECT uid FROM k GROUP BY uid HAVING count(*) > 1)""")
def flags_uid_repeated(spark, sf):
    res = apply_rules(dirty(spark, sf, UID, "uid"), [idt.uid_rules("uid")])
    return res.flags.filter("rule = 'UID-01'").select("_rid", "value")


@query("uid_top_repeated", _UID_SQL + """
SELECT uid, count(*) AS n FROM k WHERE uid IS NOT NULL GROUP BY uid HAVING count(*) > 1 ORDER BY n DESC, uid LIMIT 20""")
def uid_top_repeated(spark, sf):
    return idt.top_repeated(apply_rules(dirty(spark, sf, UID, "uid"), [idt.uid_rules("uid")]).table, "uid")


@query("uid_prefix_counts", "SELECT upper(regexp_extract(c_name, '^([A-Za-z]+)', 1)) AS prefix, count(*) AS n FROM customer GROUP BY 1")
def uid_prefix_counts(spark, sf):
    return idt.prefix_counts(table(spark, sf, "customer"), "c_name")


AGE = """CASE c_custkey % 9 WHEN 0 THEN 'twenty-five' WHEN 1 THEN 'fourty two' WHEN 2 THEN '-3' WHEN 3 THEN '1.25'
 WHEN 4 THEN '150' WHEN 5 THEN 'abc' WHEN 6 THEN 'one hundred and five' WHEN 7 THEN CAST(c_custkey % 90 AS VARCHAR(9)) ELSE '33.6' END"""


@query("clean_age", f"""
WITH d AS (SELECT c_custkey AS _rid, {AGE} AS raw FROM customer),
p AS (SELECT *, CASE raw WHEN 'twenty-five' THEN 25.0 WHEN 'fourty two' THEN 42 WHEN 'one hundred and five' THEN 105
      ELSE TRY_CAST(raw AS DOUBLE) END AS x FROM d),
q AS (SELECT *, CASE WHEN x > 0 AND x <= 2 THEN round(x, 1) ELSE round(x) END AS a FROM p)
SELECT _rid, a AS age, concat_ws(',', CASE WHEN raw = 'abc' THEN 'AGE-03' END, CASE WHEN a < 0 THEN 'AGE-09' END,
  CASE WHEN a NOT BETWEEN 0 AND 120 THEN 'AGE-04' END) AS flags FROM q""")
def clean_age(spark, sf):
    return apply_rules(dirty(spark, sf, AGE, "age"), [idt.age_rules("age")]).annotated


GENDER = """CASE c_custkey % 9 WHEN 0 THEN 'M' WHEN 1 THEN ' female' WHEN 2 THEN '3' WHEN 3 THEN 'Enby' WHEN 4 THEN 'trans'
 WHEN 5 THEN 'rather not say' WHEN 6 THEN '9' WHEN 7 THEN 'robot' ELSE NULL END"""


@query("clean_gender", f"""
WITH d AS (SELECT c_custkey AS _rid, {GENDER} AS raw FROM customer),
m AS (SELECT _rid, raw, CASE lower(trim(raw)) WHEN 'm' THEN 'Male' WHEN 'female' THEN 'Female' WHEN '3' THEN 'Non-Binary'
 WHEN 'enby' THEN 'Non-Binary' WHEN 'trans' THEN 'Transgender' WHEN 'rather not say' THEN 'Prefer Not to Say'
 WHEN '9' THEN 'Other' ELSE raw END AS gender FROM d)
SELECT _rid, gender, CASE WHEN gender = 'robot' THEN 'GEN-05' ELSE '' END AS flags FROM m""")
def clean_gender(spark, sf):
    return apply_rules(dirty(spark, sf, GENDER, "gender"), [idt.gender_rules("gender")]).annotated
