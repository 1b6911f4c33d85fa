"""Names, ids, age, gender."""
from pyspark.sql import functions as F

from ..functions.fixed_values import (AGE_WORD_TYPOS, GENDER_CODES, GENDER_LABELS, GENDER_OTHER_WORDS, GENDER_REFUSALS,
                                      GENDER_WORDS, NAME_PLACEHOLDERS, NAME_SUFFIXES, SALUTATIONS)
from ..functions.numbers import spoken_number
from ..functions.text import capitalised, digits, folded, group, lookup, map_words, null_if_in, number, squeeze
from .rules import ColumnRules, count_nulls, null_note, repeated_rows
from .similarity import near_values, rows_with_value


def name_case(v):
    """Capitalise words; O'Brien, Al-Hassan, McDonald and MacArthur keep their inner capital."""
    def word(w):
        inner = lambda mark: F.array_join(F.transform(F.split(w, mark), capitalised), mark)
        low = F.lower(w)
        return (F.when(F.contains(w, F.lit("'")), inner("'")).when(F.contains(w, F.lit("-")), inner("-"))
                .when(low.startswith("mc") & (F.length(w) > 2), F.concat(F.lit("Mc"), capitalised(F.substring(w, F.lit(3), F.length(w)))))
                .when(low.startswith("mac") & (F.length(w) > 3), F.concat(F.lit("Mac"), capitalised(F.substring(w, F.lit(4), F.length(w)))))
                .otherwise(capitalised(w)))
    return map_words(v, word)


def _any_of(options):
    return "|".join(o.replace(".", r"\.") for o in sorted(options, key=len, reverse=True))


def without_salutation(v):
    rest = F.trim(F.regexp_replace(v, rf"(?i)^\s*({_any_of(SALUTATIONS)})\.*(\s+|$)", ""))
    return F.when(rest != "", rest).otherwise(v)


_SUFFIX = rf"(?i)^(.*\S)\s+((?:{_any_of(NAME_SUFFIXES)})[.,]*)\s*$"


def name_suffix(v):
    return group(v, _SUFFIX, 2)


def without_suffix(v):
    return F.when(v.rlike(_SUFFIX), F.trim(F.regexp_extract(v, _SUFFIX, 1))).otherwise(v)


def full_name_rules(column, fuzzy=True):
    r = (ColumnRules(column)
         .change("FNAME-02", lambda c: squeeze(c.v))
         .change("FNAME-06", lambda c: null_if_in(c.v, NAME_PLACEHOLDERS))
         .change("FNAME-03", lambda c: without_salutation(c.v))
         .change("FNAME-10", lambda c: F.when(c.v.rlike(r"^\s*[^,\s][^,]*,\s*\S"), F.concat_ws(
             " ", F.trim(F.regexp_extract(c.v, r"^([^,]+),(.+)$", 2)), F.trim(F.regexp_extract(c.v, r"^([^,]+),(.+)$", 1)))).otherwise(c.v))
         .change("FNAME-04", lambda c: F.trim(F.regexp_replace(c.v, r"[^A-Za-z '\-.]", "")))
         .change("FNAME-01", lambda c: name_case(c.v))
         .derive("FNAME-14", "suffix", lambda c: name_suffix(c.v))
         .change("FNAME-14", lambda c: without_suffix(c.v))
         .flag("FNAME-05", lambda c: F.length(digits(c.raw)) > 0.3 * F.length(c.raw))
         .flag("FNAME-08", lambda c: (c.v != "") & ~F.contains(c.v, F.lit(" ")))
         .flag("FNAME-09", lambda c: F.replace(F.trim(c.raw), F.lit(" "), F.lit("")).rlike(r"^([A-Z]\.)+$"))
         .keyed_flag("FNAME-07", lambda frame, v, cur: repeated_rows(frame, v, by=F.lower(f"`{v}`"))))
    if fuzzy:
        r.keyed_flag("FNAME-11", lambda frame, v, cur: rows_with_value(frame, v, near_values(frame, v)))
    return r


def short_name_rules(column):
    return (ColumnRules(column)
            .change("SNAME-02", lambda c: squeeze(c.v))
            .change("SNAME-08", lambda c: null_if_in(c.v, NAME_PLACEHOLDERS))
            .change("SNAME-03", lambda c: without_salutation(c.v))
            .change("SNAME-01", lambda c: name_case(c.v))
            .derive("SNAME-05", "suffix", lambda c: name_suffix(c.v))
            .change("SNAME-05", lambda c: without_suffix(c.v)))


_ID = r"^([A-Za-z]*)(\d+)$"


def uid_rules(column):
    prefix = lambda c: F.upper(F.regexp_extract(c.v, _ID, 1))

    def padded(c):
        one_prefix = c.stat.get("lo") == c.stat.get("hi")
        width = c.stat.get("width")
        if not one_prefix or not width:
            return c.v
        fits = c.v.rlike(_ID)
        return F.when(fits, F.concat(F.regexp_extract(c.v, _ID, 1), F.lpad(F.regexp_extract(c.v, _ID, 2), width, "0"))).otherwise(c.v)

    return (ColumnRules(column)
            .change("UID-04", lambda c: c.v.cast("string"))
            .change("UID-08", lambda c: F.regexp_replace(c.v, r"[\s\-_]+", ""))
            .measure(lo=lambda c: F.min(F.when(c.v.rlike(_ID), prefix(c))), hi=lambda c: F.max(F.when(c.v.rlike(_ID), prefix(c))),
                     width=lambda c: F.max(F.when(c.v.rlike(_ID), F.length(F.regexp_extract(c.v, _ID, 2)))))
            .change("UID-02", padded)
            .keyed_flag("UID-01", lambda frame, v, cur: repeated_rows(frame, v))
            .flag("UID-05", lambda c: c.v.isNull() | (F.trim(c.v) == ""))
            .note("UID-03", lambda s: "several id prefixes" if s.get("lo") != s.get("hi") else None))


def top_repeated(df, column, k=20):
    """UID-01: the ids that occur most often, with counts."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")
            .orderBy(F.desc("n"), column).limit(k))


def prefix_counts(df, column):
    """UID-03: how many ids carry each alphabetic prefix."""
    p = F.upper(F.regexp_extract(F.col(column).cast("string"), r"^([A-Za-z]+)", 1))
    return df.filter(p != "").groupBy(p.alias("prefix")).agg(F.count("*").alias("n"))


def age_rules(column):
    return (ColumnRules(column)
            .change("AGE-01", lambda c: F.when(number(c.v).isNull() & c.v.isNotNull(), F.coalesce(
                F.round(spoken_number(c.v, AGE_WORD_TYPOS)).cast("long").cast("string"), c.v)).otherwise(c.v.cast("string")))
            .flag("AGE-03", lambda c: number(c.v).isNull() & (F.trim(c.v) != ""))
            .change("AGE-10", lambda c: number(F.trim(c.v)))
            .change("AGE-05", lambda c: F.when((c.v > 0) & (c.v <= 2), F.round(c.v, 1)).otherwise(F.round(c.v)))
            .flag("AGE-09", lambda c: c.v < 0)
            .flag("AGE-04", lambda c: ~c.v.between(0, 120)))


def gender_rules(column):
    return (ColumnRules(column)
            .change("GEN-04", lambda c: lookup(GENDER_CODES, F.regexp_replace(F.trim(c.v.cast("string")), r"\.0$", ""), c.v.cast("string")))
            .change("GEN-01", lambda c: lookup(GENDER_WORDS, folded(c.v), c.v))
            .change("GEN-02", lambda c: lookup(GENDER_OTHER_WORDS, folded(c.v), c.v))
            .change("GEN-03", lambda c: F.when(folded(c.v).isin(*GENDER_REFUSALS), F.lit("Prefer Not to Say")).otherwise(c.v))
            .flag("GEN-05", lambda c: ~c.v.isin(*GENDER_LABELS)))
