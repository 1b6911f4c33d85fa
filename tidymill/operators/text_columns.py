"""Free text, URL, IP address and file path columns."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions.fixed_values import FILE_EXTENSIONS, LONG_TEXT, TEXT_PLACEHOLDERS, TYPOGRAPHY, URL_PATTERN, URL_PLACEHOLDERS
from ..functions.text import folded, let, null_if_in, replace_all, squeeze
from ..plans.facts import attach
from .rules import ColumnRules, count_nulls, null_note, value_counts

_MARKUP = [(r"<[^>]+>", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\*([^*]+)\*", "$1"), (r"_([^_]+)_", "$1"),
           (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"`([^`]+)`", "$1")]
SCRIPTS = {"cyrillic": r"\u0400-\u04FF", "arabic": r"\u0600-\u06FF", "cjk": r"\u4E00-\u9FFF\u3040-\u30FF", "devanagari": r"\u0900-\u097F",
           "latin": r"\u0000-\u00FF"}


def without_markup(v):
    """Tags removed; bold, italic, link and code marks dropped, their text kept."""
    return reduce(lambda x, p: F.regexp_replace(x, *p), _MARKUP, v)


def script(v):
    """Writing system that makes up more than 30 % of the known letters (Latin: more than half); null for short text."""
    counts = {s: F.length(F.regexp_replace(v, f"[^{block}]", "")) for s, block in SCRIPTS.items()}
    total = F.greatest(reduce(lambda a, b: a + b, counts.values()), F.lit(1))
    share = F.struct(*[(n / total).alias(s) for s, n in counts.items()])

    # text without a character beyond Latin-1 needs no counting
    latin_only = ~v.rlike(r"[^\u0000-\u00FF]")
    return F.when(F.length(v) < 10, F.lit(None).cast("string")).when(latin_only, F.lit("latin")).otherwise(let(share, lambda p: reduce(
        lambda acc, s: acc.when(p[s] > (0.5 if s == "latin" else 0.3), F.lit(s)), list(SCRIPTS)[1:], F.when(p["cyrillic"] > 0.3, F.lit("cyrillic")))))


def text_rules(column):
    return (ColumnRules(column)
            .change("TEXT-01", lambda c: squeeze(c.v))
            .change("TEXT-02", lambda c: null_if_in(c.v, TEXT_PLACEHOLDERS))
            .change("TEXT-03", lambda c: replace_all(c.v, TYPOGRAPHY))
            .change("TEXT-04", lambda c: without_markup(c.v))
            .flag("TEXT-05", lambda c: F.length(c.v) > LONG_TEXT)
            .let("script", lambda c: script(c.v))
            .measure(main=lambda c: F.mode(c.get("script")))
            .flag("TEXT-08", lambda c: c.get("script") != c.stat["main"] if c.stat.get("main") else None)
            .change("TEXT-09", lambda c: F.regexp_replace(c.v, "^'(?=.)", "")))


def script_report(df, column):
    """TEXT-08: rows per writing system."""
    return df.select(script(F.col(column)).alias("script")).filter("script is not null").groupBy("script").agg(F.count("*").alias("n"))


def url_rules(column):
    lowered = lambda v: F.concat(F.regexp_extract(v, r"^([^:/?#]+://)?", 1), F.lower(F.regexp_extract(v, r"^(?:[^:/?#]+://)?([^/]*)", 1)),
                                 F.regexp_extract(v, r"^(?:[^:/?#]+://)?[^/]*(.*)$", 1))
    bare = lambda v: F.regexp_replace(F.regexp_replace(folded(v), "^https?://", ""), "/+$", "")
    plain = lambda c: ~F.contains(c.v, F.lit("?"))

    def slash(c):
        add = (c.stat.get("with_slash") or 0) > (c.stat.get("without") or 0)
        if add:
            return F.when(plain(c) & ~c.v.endswith("/"), F.concat(c.v, F.lit("/"))).otherwise(c.v)
        return F.when(plain(c), F.regexp_replace(c.v, "/+$", "")).otherwise(c.v)

    return (ColumnRules(column)
            .change("URL-05", lambda c: F.when(~(folded(c.v).isin(*URL_PLACEHOLDERS) | bare(c.v).isin(*URL_PLACEHOLDERS)), F.trim(c.v)))
            .change("URL-01", lambda c: F.when(~c.v.rlike("(?i)^https?://") & F.contains(c.v, F.lit(".")) & ~c.v.startswith("/"),
                                               F.concat(F.lit("https://"), c.v)).otherwise(c.v))
            .change("URL-02", lambda c: lowered(c.v))
            .measure(with_slash=lambda c: F.count_if(plain(c) & c.v.endswith("/")), without=lambda c: F.count_if(plain(c) & ~c.v.endswith("/")))
            .change("URL-03", slash)
            .flag("URL-04", lambda c: ~c.v.rlike(URL_PATTERN)))


_V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_H = "[0-9a-fA-F]{1,4}"
_V6 = "|".join([f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:"] + [f"(?:{_H}:){{1,{7 - k}}}(?::{_H}){{1,{k}}}" for k in range(1, 7)] + [f":(?:(?::{_H}){{1,7}}|:)"])
_V6 = f"^(?:{_V6})$"


def ip_rules(column):
    valid = lambda v: v.rlike(_V4) | v.rlike(_V6)
    octet = lambda v, i: F.regexp_extract(v, r"^(\d+)\.(\d+)\.", i).try_cast("int")
    private = lambda v: (v.rlike(_V4) & ((octet(v, 1) == 10) | ((octet(v, 1) == 172) & octet(v, 2).between(16, 31))
                                         | ((octet(v, 1) == 192) & (octet(v, 2) == 168)) | (octet(v, 1) == 127)
                                         | ((octet(v, 1) == 169) & (octet(v, 2) == 254)))
                         | (v.rlike(_V6) & v.rlike("(?i)^(::1$|f[cd]|fe[89ab])")))
    return (ColumnRules(column)
            .let("ip", lambda c: F.trim(c.v))
            .flag("IP-01", lambda c: (c.get("ip") != "") & ~valid(c.get("ip")))
            .flag("IP-02", lambda c: private(c.get("ip")))
            .flag("IP-03", lambda c: (c.get("ip").rlike(_V4) & c.get("ip").startswith("127.")) | (c.get("ip") == "::1"))
            .measure(nulls=count_nulls).note(*null_note("IP-05")))


def frequent_values(df, column, least=5, share=0.1):
    """IP-04: values that occur at least ``max(5, 10 % of all rows)`` times."""
    counts = value_counts(df.select(F.trim(F.col(column)).alias(column)), column)
    return (attach(counts, df.agg(F.count("*").alias("rows"))).filter(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("rows")))
            .select("value", "n"))


def path_rules(column):
    base = lambda c: F.substring_index(c.v, "/", -1)
    ext = lambda c: F.when(F.contains(base(c), F.lit(".")), F.lower(F.substring_index(base(c), ".", -1)))
    return (ColumnRules(column)
            .change("FILE-02", lambda c: F.translate(c.v, "\\", "/"))
            .flag("FILE-01", lambda c: (ext(c) != "") & ~ext(c).isin(*FILE_EXTENSIONS))
            .flag("FILE-03", lambda c: base(c).rlike(r'[<>:"|?* ]'))
            .measure(nulls=count_nulls).note(*null_note("FILE-04")))
