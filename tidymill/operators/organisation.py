"""Product, stock code, organisation, job title, department, reference number and version columns."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions.fixed_values import (DEPT_WORDS, HIERARCHY_MARKS, JOB_ACRONYMS, JOB_CONFLICTS, JOB_WORDS, LEGAL_SUFFIXES,
                                      ORG_ACRONYMS, ORG_SHORT, PRODUCT_ACRONYMS, PRODUCT_MARKS, SENIORITY)
from ..functions.text import capitalised, folded, group, let, lookup, map_words, title_keeping, word_list
from ..plans import ordered
from .rules import ColumnRules, count_nulls, null_note, repeated_rows, shared_rows
from .similarity import apply_variants, variant_groups


def _merge(threshold, key=None):
    return lambda frame, column, out: apply_variants(frame, column, variant_groups(frame, column, threshold, key), out)


def product_case(v):
    return map_words(v, lambda w: F.when(w.rlike(r"(?i)^\d+\s*(mg|ml|g|kg|l|mcg|iu)$"), F.lower(w))
                     .when(F.upper(w).isin(*PRODUCT_ACRONYMS), F.upper(w)).otherwise(capitalised(w)))


def product_rules(column, code_column=None, variants=True):
    kept = "".join("\\" + ch if ch in r"\-[]^" else ch for ch in PRODUCT_MARKS)
    r = (ColumnRules(column)
         .change("PROD-03", lambda c: F.trim(F.regexp_replace(c.v, rf"[^\p{{L}}\p{{N}}{kept}]", "")))
         .change("PROD-01", lambda c: product_case(c.v)))
    if variants:
        r.join("PROD-02", _merge(0.8))
    if code_column:
        r.join("PROD-05", lambda frame, v, out: recover_names(frame, v, code_column, out))
        r.flag("PROD-05", lambda c: c.v.isNull())
        r.keyed_flag("PROD-04", lambda frame, v, cur: code_conflicts(frame, v, cur.get(code_column, code_column)))
    return r


def code_conflicts(frame, name, code, rid="_rid"):
    """PROD-04: rows whose code is used with more than one name."""
    return shared_rows(frame, code, name, rid)


def recover_names(frame, name, code, out, rid="_rid"):
    """PROD-05: a missing name is taken from the last row that has the same code and a name."""
    known = (frame.filter(F.col(f"`{name}`").isNotNull() & F.col(f"`{code}`").isNotNull()).groupBy(F.col(f"`{code}`").alias("_code"))
             .agg(F.max_by(F.col(f"`{name}`"), F.col(rid)).alias("_known")))
    return (frame.join(known, F.col(f"`{code}`") == F.col("_code"), "left")
            .withColumn(out, F.coalesce(F.col(f"`{name}`"), "_known")).drop("_code", "_known"))


def check_digit_ok(v):
    """EAN-13, UPC-A (12) and EAN-8: null for other lengths."""
    n = F.length(v)
    def total(v):
        # from the right, digits before the check digit weigh 3, 1, 3, 1, ...
        body = F.reverse(v.substr(F.lit(1), F.length(v) - 1))
        return F.aggregate(F.sequence(F.lit(1), F.length(v) - 1), F.lit(0),
                           lambda acc, i: acc + body.substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.when(v.rlike(r"^(\d{8}|\d{12}|\d{13})$"), F.pmod(F.lit(10) - total(v) % 10, F.lit(10)) == v.substr(n, F.lit(1)).cast("int"))


def common_prefix(low, high):
    """Longest common prefix of a set, from its smallest and largest member."""
    if low is None or high is None:
        return ""
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:n]


def sku_rules(column, name_column=None):
    dup = (lambda frame, v, cur: shared_rows(frame, v, cur.get(name_column, name_column))) if name_column else (
        lambda frame, v, cur: repeated_rows(frame, v))
    return (ColumnRules(column)
            .change("SKU-03", lambda c: c.v.cast("string"))
            .change("SKU-01", lambda c: F.regexp_replace(F.upper(c.v), r"[^A-Z0-9-]", ""))
            .change("SKU-05", lambda c: F.nullif(c.v, F.lit("")))
            .flag("SKU-04", lambda c: ~check_digit_ok(c.v))
            .measure(lo=lambda c: F.min(c.v), hi=lambda c: F.max(c.v), short=lambda c: F.min(F.length(c.v)), long=lambda c: F.max(F.length(c.v)))
            .note("SKU-03", lambda s: "prefix " + common_prefix(s.get("lo"), s.get("hi")) if len(common_prefix(s.get("lo"), s.get("hi"))) >= 2 else None)
            .keyed_flag("SKU-02", dup))


_SUFFIX_OF = {v: k for k, vs in LEGAL_SUFFIXES.items() for v in vs}


def org_case(v):
    bare = lambda w: F.regexp_replace(F.lower(w), r"\.+$", "")
    return map_words(v, lambda w: F.when(F.upper(w).isin(*ORG_ACRONYMS), F.upper(w)).otherwise(
        F.coalesce(lookup(_SUFFIX_OF, bare(w)), capitalised(w))))


def legal_suffix(v):
    """The longest run of one to three last words that names a legal form is written in its standard form."""
    def attempt(ws, k):
        n = F.size(ws)
        tail = F.lower(F.array_join(F.slice(ws, F.greatest(n - (k - 1), F.lit(1)), F.lit(k)), " "))
        head = F.slice(ws, F.lit(1), F.greatest(n - k, F.lit(0)))
        return F.when(n >= k, let(lookup(_SUFFIX_OF, tail), lambda found: F.when(
            found.isNotNull(), F.array_join(F.concat(head, F.array(found)), " "))))
    return let(word_list(v), lambda ws: F.coalesce(*[attempt(ws, k) for k in (3, 2, 1)], F.array_join(ws, " ")))


def org_rules(column, variants=True):
    r = (ColumnRules(column)
         .change("ORG-01", lambda c: org_case(c.v))
         .change("ORG-02", lambda c: F.when(F.trim(c.v) != "", legal_suffix(c.v)).otherwise(c.v))
         .change("ORG-03", lambda c: lookup(ORG_SHORT, folded(c.v), c.v)))
    if variants:
        r.join("ORG-04", _merge(0.85))
    return r.measure(nulls=count_nulls).note(*null_note("ORG-05"))


def expand_title(v):
    return map_words(v, lambda w: lookup(JOB_WORDS, F.regexp_replace(F.lower(w), r"\.+$", ""), w))


def seniority(v):
    """(keyword, level) of the longest keyword contained in the title."""
    chain = None
    for word in sorted(SENIORITY, key=lambda w: -len(w)):
        value = F.struct(F.lit(word.title()).alias("keyword"), F.lit(SENIORITY[word]).alias("level"))
        hit = F.contains(F.lower(v), F.lit(word))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def title_conflict(title, dept):
    t, d = F.lower(title), F.lower(dept)
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(k)) & F.exists(F.array(*[F.lit(x) for x in ds]), lambda x: F.contains(d, x))
                                       for k, ds in JOB_CONFLICTS.items()])


def job_rules(column, department_column=None, variants=True):
    r = (ColumnRules(column)
         .change("JOB-01", lambda c: title_keeping(c.v, JOB_ACRONYMS))
         .change("JOB-02", lambda c: expand_title(c.v)))
    if variants:
        r.join("JOB-03", _merge(0.85, F.lower(expand_title(F.col("value")))))
    r.derive("JOB-04", "seniority", lambda c: seniority(c.v).getField("keyword"))
    r.derive("JOB-04", "level", lambda c: seniority(c.v).getField("level"))
    if department_column:
        r.flag("JOB-05", lambda c: title_conflict(c.v, c.other(department_column)))
    return r


def department_rules(column, variants=True):
    first_mark = lambda v: reduce(lambda acc, m: acc.when(F.contains(v, F.lit(m)), F.lit(m)), HIERARCHY_MARKS[1:],
                                  F.when(F.contains(v, F.lit(HIERARCHY_MARKS[0])), F.lit(HIERARCHY_MARKS[0])))

    def piece(c, at):
        return let(first_mark(c.v), lambda mark: F.when(mark.isNotNull(), F.trim(
            F.element_at(F.split(c.v, F.concat(F.lit("\\Q"), mark, F.lit("\\E"))), at))))

    r = (ColumnRules(column)
         .change("DEPT-01", lambda c: title_keeping(c.v, JOB_ACRONYMS))
         .change("DEPT-02", lambda c: lookup(DEPT_WORDS, folded(c.v), c.v)))
    if variants:
        r.join("DEPT-03", _merge(0.8))
    return (r.derive("DEPT-04", "parent", lambda c: piece(c, 1)).derive("DEPT-04", "child", lambda c: piece(c, -1))
            .measure(nulls=count_nulls).note(*null_note("DEPT-05")))


def reference_rules(column):
    """REFNO-02 takes the prefix shared by at least 90 % of the values; a prefix shared by all could flag nothing."""
    prefix = lambda c: F.regexp_extract(c.v, r"^(\D*)", 1)
    tail = lambda c: group(c.v, r"(\d+)$", 1).try_cast("long")
    def likely(s):
        """A sketch surely holds a prefix that 90 % of the values share; whether they do is counted."""
        return s["prefixes"][0]["item"] if s.get("prefixes") else None

    def usual(s):
        return likely(s) if s.get("agree") and s["agree"] >= 0.9 * s["hits"] else None

    return (ColumnRules(column)
            .change("REFNO-03", lambda c: c.v.cast("string"))
            .measure(prefixes=lambda c: F.call_function("approx_top_k", F.nullif(prefix(c), F.lit("")), F.lit(1)), hits=lambda c: F.count(c.v), nulls=count_nulls,
                     top=lambda c: F.max(tail(c)))
            .measure(agree=lambda c: F.count_if(prefix(c) == F.lit(likely(c.stat))))
            .flag("REFNO-02", lambda c: ~c.v.startswith(usual(c.stat)) if usual(c.stat) else None)
            .keyed_flag("REFNO-01", lambda frame, v, cur: repeated_rows(frame, v))
            .note("REFNO-05", lambda s: f"{s['nulls']} missing, next number {s['top'] + 1}" if s.get("nulls") and s.get("top") is not None else None))


def reference_gaps(df, column):
    """REFNO-04: runs of missing numbers between the smallest and the largest trailing number."""
    numbers = df.select(group(F.col(column).cast("string"), r"(\d+)$", 1).try_cast("long").alias("k"))
    return ordered.integer_gaps(numbers, "k")


_VERSION = r"(?i)^(?:v|r|version\s*|ver\.?\s*|release\s*)?(\d+)(?:\.(\d+))?(?:\.(\d+))?$"


def version_parts(v):
    t = F.trim(v)
    part = lambda i: F.coalesce(F.regexp_extract(t, _VERSION, i).try_cast("int"), F.lit(0))
    return F.when(t.rlike(_VERSION), F.array(part(1), part(2), part(3)))


def version_rules(column):
    shown = lambda p: F.concat(F.lit("v"), F.get(p, 0).cast("string"), F.lit("."), F.get(p, 1).cast("string"),
                               F.when(F.get(p, 2) > 0, F.concat(F.lit("."), F.get(p, 2).cast("string"))).otherwise(""))
    return (ColumnRules(column)
            .let("parts", lambda c: version_parts(c.v.cast("string")))
            .flag("VER-02", lambda c: c.v.isNotNull() & c.get("parts").isNull())
            .change("VER-01", lambda c: F.coalesce(shown(c.get("parts")), c.v.cast("string")))
            .derive("VER-03", "sort_key", lambda c: c.get("parts"))
            .measure(nulls=count_nulls).note(*null_note("VER-04")))
