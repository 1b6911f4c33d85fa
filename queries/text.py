from pyspark.sql import functions as F

from tidymill.operators import text_columns as tx
from tidymill.operators.rules import apply_rules
from . import query, table
from .people import dirty

NOTE = """CASE doc_id % 6 WHEN 0 THEN '<p>' || text || '</p>' WHEN 1 THEN '**' || text || '** [see](http://x.y)' WHEN 2 THEN '_' || text || '_'
 WHEN 3 THEN chr(39) || 'quoted ' || text ELSE text END"""
_NOTE = f"""
WITH d AS (SELECT doc_id AS _rid, {NOTE} AS raw FROM documents),
a AS (SELECT *, trim(regexp_replace(raw, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS v1 FROM d),
b AS (SELECT *, CASE WHEN lower(trim(v1)) <> '[blank]' THEN v1 END AS v2 FROM a),
c AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(v2, '’', chr(39)), '“', '"'), '”', '"'), '–', '-'), '—', '-'), '…', '...'), chr(160), ' ') AS v3 FROM b),
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v3, '<[^>]+>', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'),
  '__([^_]+)__', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '_([^_]+)_', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`([^`]+)`', '\\1', 'g') AS v4 FROM c),
f AS (SELECT _rid, v4, CASE WHEN v4[1] = chr(39) AND length(v4) > 1 THEN v4[2:] ELSE v4 END AS notes FROM e)
"""
_SCRIPT = """CASE WHEN length(v) < 10 THEN NULL ELSE (SELECT CASE WHEN cy / t > 0.3 THEN 'cyrillic' WHEN ar / t > 0.3 THEN 'arabic' WHEN cj / t > 0.3 THEN 'cjk'
 WHEN de / t > 0.3 THEN 'devanagari' WHEN la / t > 0.5 THEN 'latin' END) END"""


@query("clean_text", _NOTE + "SELECT _rid, md5(notes) AS notes, length(notes) AS n, CASE WHEN length(v4) > 5000 THEN 'TEXT-05' ELSE '' END AS flags FROM f")
def clean_text(spark, sf):
    out = apply_rules(dirty(spark, sf, NOTE, "notes", "documents", "doc_id"), [tx.text_rules("notes")]).annotated
    return out.select("_rid", F.md5("notes").alias("notes"), F.length("notes").alias("n"), "flags")


@query("clean_text_placeholder", """
SELECT doc_id AS _rid, CASE WHEN doc_id % 3 <> 0 THEN source END AS notes, '' AS flags FROM documents""")
def clean_text_placeholder(spark, sf):
    return apply_rules(dirty(spark, sf, "CASE WHEN doc_id % 3 = 0 THEN ' [blank] ' ELSE source END", "notes", "documents", "doc_id"), [tx.text_rules("notes")]).annotated


@query("html_strip", """
WITH t AS (SELECT page_id AS _rid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'),
  '__([^_]+)__', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '_([^_]+)_', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`([^`]+)`', '\\1', 'g') AS v FROM pages)
SELECT _rid, md5(v) AS text_md5, length(v) AS n FROM t""")
def html_strip(spark, sf):
    pages = table(spark, sf, "pages")
    bare = pages.select(F.col("page_id").alias("_rid"), tx.without_markup(F.col("html")).alias("t"))
    return bare.select("_rid", F.md5("t").alias("text_md5"), F.length("t").alias("n"))


MIXED = "CASE WHEN doc_id % 9 = 0 THEN repeat('привет мир ', 3) WHEN doc_id % 9 = 1 THEN repeat('नमस्ते दुनिया ', 3) WHEN doc_id % 9 = 2 THEN 'short' ELSE text END"


@query("script_report", """
SELECT CASE doc_id % 9 WHEN 0 THEN 'cyrillic' WHEN 1 THEN 'devanagari' ELSE 'latin' END AS script, count(*) AS n FROM documents
WHERE doc_id % 9 <> 2 AND (doc_id % 9 < 2 OR (length(text) >= 10 AND length(regexp_replace(text, '[^\\x{0000}-\\x{00FF}]', '', 'g')) > 0.5 * length(
 regexp_replace(text, '[^\\x{0000}-\\x{00FF}\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{0900}-\\x{097F}]', '', 'g')))) GROUP BY 1""")
def script_report(spark, sf):
    return tx.script_report(dirty(spark, sf, MIXED, "t", "documents", "doc_id"), "t")


@query("flags_script", "SELECT doc_id AS _rid, 'TEXT-08' AS flags FROM documents WHERE doc_id % 9 IN (0, 1)")
def flags_script(spark, sf):
    out = apply_rules(dirty(spark, sf, MIXED, "t", "documents", "doc_id"), [tx.text_rules("t")])
    return out.flags.filter("rule = 'TEXT-08'").select("_rid", F.col("rule").alias("flags"))


URL = """CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'WWW.Site' || CAST(page_id AS VARCHAR(9)) || '.ORG/Path/' WHEN 2 THEN 'http://example.com/' WHEN 3 THEN 'not a url' WHEN 4 THEN upper(url) ELSE NULL END"""
_URL = f"""
WITH d AS (SELECT page_id AS _rid, page_id % 6 AS k, {URL} AS raw FROM pages),
b AS (SELECT *, CASE k WHEN 1 THEN 'https://' || raw WHEN 2 THEN NULL ELSE raw END AS u FROM d),
l AS (SELECT *, regexp_extract(u, '^([^:/?#]+://)?', 1) || lower(regexp_extract(u, '^(?:[^:/?#]+://)?([^/]*)', 1)) || regexp_extract(u, '^(?:[^:/?#]+://)?[^/]*(.*)$', 1) AS w FROM b),
v AS (SELECT count(*) FILTER (NOT contains(w, '?') AND w LIKE '%/') > count(*) FILTER (NOT contains(w, '?') AND w NOT LIKE '%/') AS add FROM l),
f AS (SELECT _rid, CASE WHEN contains(w, '?') THEN w WHEN add THEN CASE WHEN w LIKE '%/' THEN w ELSE w || '/' END ELSE regexp_replace(w, '/+$', '') END AS link FROM l, v)
"""


@query("clean_url", _URL + """
SELECT _rid, link, CASE WHEN NOT regexp_full_match(link, '(?i)(https?://)?([a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\\.)+[a-zA-Z]{2,}(:[0-9]{1,5})?(/[^\\s]*)?')
 THEN 'URL-04' ELSE '' END AS flags FROM f""")
def clean_url(spark, sf):
    return apply_rules(dirty(spark, sf, URL, "link", "pages", "page_id"), [tx.url_rules("link")]).annotated


IP = """CASE event_id % 10 WHEN 0 THEN '10.0.0.' || CAST(event_id % 256 AS VARCHAR(9)) WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '::1' WHEN 3 THEN '300.1.1.1' WHEN 4 THEN '172.20.3.4'
 WHEN 5 THEN 'fe80::1' WHEN 6 THEN '2001:db8::8a2e:370:7334' WHEN 7 THEN NULL WHEN 8 THEN ' 8.8.8.8 ' ELSE '192.168.1.1' END"""


@query("clean_ip", f"""
WITH d AS (SELECT event_id AS _rid, event_id % 10 AS k, {IP} AS ip FROM events)
SELECT _rid, ip, ['IP-02', 'IP-02,IP-03', 'IP-02,IP-03', 'IP-01', 'IP-02', 'IP-02', '', '', '', 'IP-02'][k + 1] AS flags FROM d""")
def clean_ip(spark, sf):
    return apply_rules(dirty(spark, sf, IP, "ip", "events", "event_id"), [tx.ip_rules("ip")]).annotated


@query("frequent_ips", f"""
WITH d AS (SELECT trim({IP}) AS value FROM events)
SELECT value, count(*) AS n FROM d WHERE value IS NOT NULL GROUP BY value HAVING count(*) >= greatest(5, 0.1 * (SELECT count(*) FROM d))""")
def frequent_ips(spark, sf):
    return tx.frequent_values(dirty(spark, sf, IP, "ip", "events", "event_id"), "ip")


FILE = """CASE doc_id % 5 WHEN 0 THEN 'C:' || chr(92) || 'data' || chr(92) || 'x.PDF' WHEN 1 THEN '/tmp/my file.txt' WHEN 2 THEN 'a/b.weird' WHEN 3 THEN NULL ELSE 'folder.d/readme' END"""


@query("clean_path", """
WITH d AS (SELECT doc_id AS _rid, doc_id % 5 AS k FROM documents)
SELECT _rid, ['C:/data/x.PDF', '/tmp/my file.txt', 'a/b.weird', NULL, 'folder.d/readme'][k + 1] AS f, ['', 'FILE-03', 'FILE-01', '', ''][k + 1] AS flags FROM d""")
def clean_path(spark, sf):
    return apply_rules(dirty(spark, sf, FILE, "f", "documents", "doc_id"), [tx.path_rules("f")]).annotated


@query("notes_path", "SELECT 'FILE-04' AS rule, count(*) || ' missing' AS value FROM documents WHERE doc_id % 5 = 3")
def notes_path(spark, sf):
    return apply_rules(dirty(spark, sf, FILE, "f", "documents", "doc_id"), [tx.path_rules("f")]).flags.filter("rule = 'FILE-04'").select("rule", "value")
