from pyspark.sql import functions as F

from tidymill.operators import duplicates as dp
from . import query, table

_COPIES = """SELECT c_custkey AS _rid, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
 UNION ALL SELECT c_custkey + 10000000, CASE WHEN c_custkey % 10 = 2 THEN upper(c_name) ELSE c_name END, CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_nationkey END,
  CASE WHEN c_custkey % 10 = 3 THEN 'OTHER' ELSE c_mktsegment END FROM customer WHERE c_custkey % 10 < 4"""


def copies(spark, sf):
    c = table(spark, sf, "customer")
    more = c.filter("c_custkey % 10 < 4").selectExpr(
        "c_custkey + 10000000 AS _rid", "CASE WHEN c_custkey % 10 = 2 THEN upper(c_name) ELSE c_name END AS name",
        "CASE WHEN c_custkey % 10 = 1 THEN NULL ELSE c_nationkey END AS nation", "CASE WHEN c_custkey % 10 = 3 THEN 'OTHER' ELSE c_mktsegment END AS segment")
    return c.selectExpr("c_custkey AS _rid", "c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment").unionByName(more)


@query("dedupe_exact", f"WITH d AS ({_COPIES}) SELECT min(_rid) AS _rid, name, nation, segment FROM d GROUP BY name, nation, segment")
def dedupe_exact(spark, sf):
    return dp.drop_exact(copies(spark, sf))


@query("dedupe_documents", "SELECT min(doc_id) AS kept_rid, count(*) AS n_rows FROM documents GROUP BY text, lang HAVING count(*) > 1")
def dedupe_documents(spark, sf):
    return dp.exact_groups(table(spark, sf, "documents").select(F.col("doc_id").alias("_rid"), "text", "lang"))


@query("duplicates_partial", f"""
WITH d AS ({_COPIES}), g AS (SELECT lower(trim(name)) AS key_name, count(*) AS n_rows, min(_rid) AS first_rid, count(DISTINCT nation) > 1 AS c1, count(DISTINCT segment) > 1 AS c2,
  count(nation) BETWEEN 1 AND count(*) - 1 AS g1, count(segment) BETWEEN 1 AND count(*) - 1 AS g2 FROM d GROUP BY 1)
SELECT key_name, n_rows, first_rid, concat_ws(',', CASE WHEN c1 THEN 'nation' END, CASE WHEN c2 THEN 'segment' END) AS conflicts, NOT (c1 OR c2) AS can_merge
FROM g WHERE n_rows > 1 AND (c1 OR c2 OR g1 OR g2)""")
def duplicates_partial(spark, sf):
    g = dp.partial_groups(copies(spark, sf), ["name"])
    return g.select("key_name", "n_rows", "first_rid", F.array_join("conflicts", ",").alias("conflicts"), "can_merge")


@query("merge_suggestion", """
SELECT c_custkey AS _rid, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, 2 AS n_rows, CASE WHEN c_custkey % 20 = 1 THEN 'segment' ELSE '' END AS filled FROM customer WHERE c_custkey % 10 = 1""")
def merge_suggestion(spark, sf):
    # the first of two rows lacks the segment in every other group
    df = copies(spark, sf).withColumn("segment", F.expr("CASE WHEN _rid % 20 = 1 AND _rid < 10000000 THEN NULL ELSE segment END"))
    return dp.merged_rows(df, ["name"]).select("_rid", "name", "nation", "segment", "n_rows", F.array_join("filled_columns", ",").alias("filled"))


@query("duplicates_temporal", """
SELECT CAST(user_id AS VARCHAR) AS key_user_id, event_type AS key_event_type, count(*) AS n_rows, count(DISTINCT CAST(ts AS DATE)) AS n_moments FROM events
GROUP BY user_id, event_type HAVING count(DISTINCT CAST(ts AS DATE)) > 1""")
def duplicates_temporal(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").alias("_rid"), "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return dp.temporal_groups(ev, ["user_id", "event_type"], ["day"])


_PEOPLE = """SELECT c_custkey AS _rid, substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 8) || ' ' || substr(md5(CAST(c_custkey AS VARCHAR(20))), 9, 7) AS name,
  'ID' || CAST(100000 + c_custkey AS VARCHAR(20)) AS code, substr(md5(CAST(c_custkey AS VARCHAR(20))), 20, 8) || '@mail.org' AS email FROM customer
 UNION ALL SELECT c_custkey + 10000000, substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 8) || ' ' || substr(md5(CAST(c_custkey AS VARCHAR(20))), 9, 6) || 'x',
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'ID' || CAST(100000 + c_custkey AS VARCHAR(20)) END, CASE WHEN c_custkey % 2 = 0 THEN 'shared@office.org' ELSE substr(md5(CAST(c_custkey AS VARCHAR(20))), 20, 8) || '@mail.com' END
  FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT c_custkey + 20000000, substr(md5(CAST(c_custkey AS VARCHAR(20))), 9, 7) || ' ' || substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 8), 'ID' || CAST(100000 + c_custkey AS VARCHAR(20)), 'shared@office.org'
  FROM customer WHERE c_custkey % 11 = 0"""


def people(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer_people")
    return spark.sql(_PEOPLE.replace("FROM customer", "FROM customer_people"))


_SIM = "CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 - levenshtein(a.{c}, b.{c}) / greatest(length(a.{c}), length(b.{c})) END"
_SOUND = "regexp_replace(" * 14 + "lower(trim(name))" + "".join(f", '{p}', '{r}', 'g')" for p, r in dp.SPOKEN_SOUNDS[:-1])
# a run of one letter collapses; the engine has no back-reference, so the letters are listed
for _ch in "abcdefghijklmnopqrstuvwxyz0123456789 ":
    _SOUND = f"regexp_replace({_SOUND}, '{_ch}{_ch}+', '{_ch}', 'g')"


@query("duplicates_fuzzy", f"""
WITH d AS ({_PEOPLE}), t AS (SELECT min(_rid) AS rid, name AS n0, {_SOUND} AS n1, array_to_string(list_sort(string_split(name, ' ')), ' ') AS n2, code AS i, email AS c, substr(name, 1, 3) AS block
  FROM d GROUP BY name, code, email),
s AS (SELECT a.rid AS rid_a, b.rid AS rid_b, greatest({_SIM.format(c='n0')}, {_SIM.format(c='n1')}, {_SIM.format(c='n2')}) AS n, {_SIM.format(c='i')} AS i, {_SIM.format(c='c')} AS c
  FROM t a JOIN t b ON a.block = b.block AND a.rid < b.rid),
w AS (SELECT rid_a, rid_b, (0.4 * n + 0.3 * coalesce(i, 0) + 0.3 * coalesce(c, 0)) / (0.4 + CASE WHEN i IS NULL THEN 0 ELSE 0.3 END + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END) AS score FROM s)
SELECT rid_a, rid_b, round(score, 4) AS score FROM w WHERE score >= 0.85 - 1e-12""")
def duplicates_fuzzy(spark, sf):
    return dp.fuzzy_pairs(people(spark, sf), ["name"], ["code"], ["email"]).select("rid_a", "rid_b", F.round("score", 4).alias("score"))


@query("duplicates_fuzzy_groups")
def duplicates_fuzzy_groups(spark, sf):
    return dp.fuzzy_groups(people(spark, sf), ["name"], ["code"], ["email"])


@query("duplicates_summary", f"""
WITH d AS ({_COPIES}), e AS (SELECT count(*) AS n FROM d GROUP BY name, nation, segment HAVING count(*) > 1),
g AS (SELECT count(*) AS n, count(DISTINCT nation) > 1 OR count(DISTINCT segment) > 1 OR count(nation) BETWEEN 1 AND count(*) - 1 AS differs FROM d GROUP BY lower(name))
SELECT 'exact' AS kind, count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_rows FROM e
UNION ALL SELECT 'partial', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM g WHERE n > 1 AND differs""")
def duplicates_summary(spark, sf):
    return dp.summary(copies(spark, sf), ["name"])
