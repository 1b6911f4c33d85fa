from pyspark.sql import functions as F

from tidymill.operators import categorical as cg
from tidymill.operators.rules import apply_rules
from . import query, table
from .people import dirty

BOOL = """CASE event_id % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN ' n ' WHEN 2 THEN '1' WHEN 3 THEN 'maybe' WHEN 4 THEN 'oui' WHEN 5 THEN 'disabled' WHEN 6 THEN NULL ELSE 'blue' END"""


@query("clean_boolean", """
WITH d AS (SELECT event_id AS _rid, event_id % 8 AS k FROM events)
SELECT _rid, [true, false, true, NULL, true, false, NULL, NULL][k + 1] AS is_on, CASE k WHEN 3 THEN 'BOOL-02' WHEN 7 THEN 'BOOL-01' ELSE '' END AS flags FROM d""")
def clean_boolean(spark, sf):
    return apply_rules(dirty(spark, sf, BOOL, "is_on", "events", "event_id"), [cg.boolean_rules("is_on")]).annotated


@query("boolean_as_number", "SELECT event_id AS _rid, [1, 0, 1, NULL, 1, 0, NULL, NULL][event_id % 8 + 1] AS is_on FROM events")
def boolean_as_number(spark, sf):
    return apply_rules(dirty(spark, sf, BOOL, "is_on", "events", "event_id"), [cg.boolean_rules("is_on", as_number=True)]).table


@query("notes_boolean", """
WITH d AS (SELECT event_id % 8 AS k FROM events)
SELECT 'BOOL-03' AS rule, count(*) FILTER (k IN (3, 6, 7)) || ' missing, ' || count(*) FILTER (k IN (1, 5)) || ' false' AS value FROM d""")
def notes_boolean(spark, sf):
    res = apply_rules(dirty(spark, sf, BOOL, "is_on", "events", "event_id"), [cg.boolean_rules("is_on")])
    return res.flags.filter("rule = 'BOOL-03'").select("rule", "value")


CATEGORY = """CASE WHEN c_custkey = 7 THEN 'Machnery' WHEN c_custkey = 1234 THEN 'Buildng' WHEN c_custkey = 900 THEN 'zebra' WHEN c_custkey % 20 = 0 THEN 'it  support'
 WHEN c_custkey % 20 = 1 THEN 'IT' WHEN c_custkey % 20 = 2 THEN lower(c_mktsegment) || ' ' WHEN c_custkey % 20 = 3 THEN NULL ELSE c_mktsegment END"""
_CATEGORY = f"""
WITH d AS (SELECT c_custkey AS _rid, {CATEGORY} AS raw FROM customer),
t AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS v FROM d),
p AS (SELECT _rid, CASE WHEN v = 'it support' THEN 'IT Support' WHEN v = upper(v) AND length(v) <= 5 THEN v ELSE upper(v[1]) || lower(v[2:]) END AS w FROM t),
p2 AS (SELECT _rid, CASE w WHEN 'Machnery' THEN 'Machinery' WHEN 'Buildng' THEN 'Building' ELSE w END AS seg FROM p)
"""


@query("clean_category", _CATEGORY + "SELECT _rid, seg FROM p2")
def clean_category(spark, sf):
    return apply_rules(dirty(spark, sf, CATEGORY, "seg"), [cg.category_rules("seg")]).table


@query("flags_rare_category", _CATEGORY + """,
c AS (SELECT seg, count(*) AS n FROM p2 WHERE seg IS NOT NULL GROUP BY seg)
SELECT _rid, seg AS value FROM p2 WHERE seg IN (SELECT seg FROM c WHERE n < 0.01 * (SELECT sum(n) FROM c))""")
def flags_rare_category(spark, sf):
    return apply_rules(dirty(spark, sf, CATEGORY, "seg"), [cg.category_rules("seg")]).flags.filter("rule = 'CAT-04'").select("_rid", "value")


SPELLING = "CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) ELSE c_mktsegment END"


@query("most_frequent_spelling", f"""
WITH d AS (SELECT c_custkey AS _rid, {SPELLING} AS v FROM customer),
c AS (SELECT v, lower(v) AS k, count(*) AS n FROM d GROUP BY v),
b AS (SELECT k, arg_max(v, (n, v)) AS best FROM c GROUP BY k)
SELECT _rid, best AS v FROM d JOIN b ON lower(v) = k""")
def most_frequent_spelling(spark, sf):
    return cg.most_frequent_spelling(dirty(spark, sf, SPELLING, "raw"), "raw", "v").select("_rid", "v")


@query("category_report", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def category_report(spark, sf):
    return cg.category_report(table(spark, sf, "customer"), "c_mktsegment")


STATUS = """CASE o_orderkey % 9 WHEN 0 THEN 'DONE' WHEN 1 THEN ' in progress' WHEN 2 THEN 'on hold' WHEN 3 THEN 'draft' WHEN 4 THEN NULL WHEN 5 THEN 'created'
 WHEN 6 THEN 'closed' WHEN 7 THEN CASE WHEN o_orderkey % 900 = 7 THEN 'limbo' ELSE 'shipped' END ELSE 'voided' END"""
_STATUS = f"""
WITH d AS (SELECT o_orderkey AS _rid, o_orderkey % 9 AS k, {STATUS} AS raw FROM orders),
p AS (SELECT _rid, CASE WHEN raw = 'limbo' THEN 'Limbo' ELSE ['Completed', 'Active', 'Pending', 'Draft', NULL, 'New', 'Completed', 'Completed', 'Cancelled'][k + 1] END AS st FROM d)
"""


@query("clean_status", _STATUS + """
SELECT _rid, st, concat_ws(',', CASE WHEN st IN ('Draft', 'Cancelled') THEN 'STAT-02' END, CASE WHEN st IS NULL THEN 'STAT-04' END) AS flags FROM p""")
def clean_status(spark, sf):
    return apply_rules(dirty(spark, sf, STATUS, "st", "orders", "o_orderkey"), [cg.status_rules("st")]).annotated


@query("flags_retired_status", _STATUS + """,
c AS (SELECT st, count(*) AS n FROM p WHERE st IS NOT NULL GROUP BY st)
SELECT _rid, st AS value FROM p WHERE st IN (SELECT st FROM c WHERE n < 0.01 * (SELECT sum(n) FROM c))""")
def flags_retired_status(spark, sf):
    return apply_rules(dirty(spark, sf, STATUS, "st", "orders", "o_orderkey"), [cg.status_rules("st")]).flags.filter("rule = 'STAT-05'").select("_rid", "value")


SURVEY = """CASE event_id % 8 WHEN 0 THEN 'Strongly agree' WHEN 1 THEN 'nutral' WHEN 2 THEN 'disagre' WHEN 3 THEN '4' WHEN 4 THEN 'whatever' WHEN 5 THEN NULL WHEN 6 THEN 'AGREE' ELSE 'often' END"""


@query("clean_survey", """
WITH d AS (SELECT event_id AS _rid, event_id % 8 AS k FROM events)
SELECT _rid, ['Strongly agree', 'Neutral', 'Disagree', '4', 'whatever', NULL, 'AGREE', 'often'][k + 1] AS q1, [5, 3, 2, 4, NULL, NULL, 4, 4][k + 1] AS q1_score,
 CASE WHEN k = 4 THEN 'SURV-05' ELSE '' END AS flags FROM d""")
def clean_survey(spark, sf):
    return apply_rules(dirty(spark, sf, SURVEY, "q1", "events", "event_id"), [cg.survey_rules("q1")]).annotated


@query("flags_straight_lining", """
SELECT event_id AS _rid FROM events WHERE event_id % 3 = 0""")
def flags_straight_lining(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id AS _rid", "CAST(event_id % 5 + 1 AS STRING) AS q1",
                                               "CAST((event_id + event_id % 3) % 5 + 1 AS STRING) AS q2", "CAST(event_id % 5 + 1 AS STRING) AS q3")
    res = apply_rules(df, [cg.survey_rules("q1", ("q2", "q3"))])
    return res.flags.filter("rule = 'SURV-06'").select("_rid")


@query("survey_scale", "SELECT 'SURV-01' AS rule, 'scale numeric_5' AS value UNION ALL SELECT 'SURV-07', count(*) || ' missing' FROM events WHERE event_id % 7 = 0")
def survey_scale(spark, sf):
    df = dirty(spark, sf, "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5 + 1 AS STRING) END", "q1", "events", "event_id")
    return apply_rules(df, [cg.survey_rules("q1")]).flags.filter("rule in ('SURV-01', 'SURV-07')").select("rule", "value")


TAGS = """CASE p_partkey % 7 WHEN 0 THEN 'red; blue,green' WHEN 1 THEN 'IT and sales' WHEN 2 THEN 'wood / steel' WHEN 3 THEN NULL WHEN 4 THEN 'single' WHEN 5 THEN 'Plastics| plastic' ELSE p_name || ', ' || p_brand END"""
_TAGS = f"""
WITH d AS (SELECT p_partkey AS _rid, p_partkey % 7 AS k, {TAGS} AS raw FROM part),
s AS (SELECT _rid, k, raw, [trim(x) FOR x IN string_split_regex(raw, '[,;|/&]| and ') IF trim(x) <> ''] AS parts FROM d)
"""
_PART_CASE = """CASE WHEN x = upper(x) AND x <> lower(x) AND length(x) <= 5 THEN x
 ELSE array_to_string([CASE WHEN upper(w) IN ('IT', 'HR') THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END FOR w IN string_split(x, ' ')], ' ') END"""


@query("clean_multi_value", _TAGS + f"SELECT _rid, CASE WHEN raw IS NOT NULL THEN array_to_string([{_PART_CASE} FOR x IN parts], ', ') END AS tags FROM s")
def clean_multi_value(spark, sf):
    return apply_rules(dirty(spark, sf, TAGS, "tags", "part", "p_partkey"), [cg.multi_value_rules("tags", variants=False)]).table


@query("multi_value_delimiters", f"""
WITH d AS (SELECT {TAGS} AS v FROM part),
m AS (SELECT unnest([',', ';', '|', '/', '&', ' and ', chr(10), '\\n']) AS delimiter)
SELECT delimiter, CAST(sum((length(v) - length(replace(v, delimiter, ''))) / length(delimiter)) AS BIGINT) AS occurrences,
 round(count(*) FILTER (contains(v, delimiter)) / count(v), 4) AS cell_share FROM d, m GROUP BY delimiter""")
def multi_value_delimiters(spark, sf):
    return cg.delimiter_stats(dirty(spark, sf, TAGS, "tags", "part", "p_partkey"), "tags")


@query("multi_value_detect", f"""
WITH d AS (SELECT {TAGS} AS v FROM part)
SELECT ',' AS delimiter, count(*) FILTER (contains(v, ',')) >= 0.2 * count(v) AS is_multi_value FROM d""")
def multi_value_detect(spark, sf):
    return cg.detect_delimiter(multi_value_delimiters(spark, sf))


@query("multi_value_explode", _TAGS + "SELECT _rid, unnest(CASE WHEN len(parts) > 0 THEN parts ELSE [NULL] END) AS value FROM s")
def multi_value_explode(spark, sf):
    return cg.exploded(dirty(spark, sf, TAGS, "tags", "part", "p_partkey"), "tags").select("_rid", "value")


@query("multi_value_counts", _TAGS + ", e AS (SELECT unnest(parts) AS value FROM s) SELECT value, count(*) AS n FROM e GROUP BY value")
def multi_value_counts(spark, sf):
    return cg.part_counts(dirty(spark, sf, TAGS, "tags", "part", "p_partkey"), "tags")


@query("multi_value_growth", _TAGS + "SELECT count(*) AS current_rows, CAST(sum(len(parts)) AS BIGINT) AS exploded_rows FROM s")
def multi_value_growth(spark, sf):
    return cg.explosion_size(dirty(spark, sf, TAGS, "tags", "part", "p_partkey"), "tags")


@query("multi_value_variants", """
SELECT p_partkey AS _rid, CASE p_partkey % 4 WHEN 0 THEN 'Electric Motor, Cable' WHEN 1 THEN 'Electric Motor, Ring' WHEN 2 THEN 'Cable' END AS tags FROM part""")
def multi_value_variants(spark, sf):
    expr = "CASE p_partkey % 4 WHEN 0 THEN 'electric motor; cable' WHEN 1 THEN 'electric motors| ring' WHEN 2 THEN 'cable' ELSE NULL END"
    return apply_rules(dirty(spark, sf, expr, "tags", "part", "p_partkey"), [cg.multi_value_rules("tags")]).table
