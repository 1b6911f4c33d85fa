"""Amount, quantity, percentage, score, currency, rank and calculated columns."""
from itertools import combinations

from pyspark.sql import functions as F

from ..functions.fixed_values import (APPROX_BACK, APPROX_FRONT, NUMBER_THEN_UNIT, UNIT_THEN_NUMBER, AGE_WORD_TYPOS, AMOUNT_WORD_TYPOS, CURRENCY_SYMBOLS, GPA_POINTS, GRADE_BANDS, GRADE_WORDS,
                                      ISO_4217, NUMBER_SCALES, NUMBER_WORDS, ORDINAL_WORDS)
from ..functions.numbers import (SCIENTIFIC, currency_of, from_european, is_european, parse_number, plain_decimal, spoken_number,
                                 without_currency, without_thousands)
from ..functions.text import folded, group, let, lookup, number
from ..plans import ordered
from .rules import ColumnRules, repeated_rows


def _has(column, words):
    return any(w in column.lower() for w in words)


def _words_to_number(c, typos=AMOUNT_WORD_TYPOS):
    """Text without a digit that reads as a number word becomes that number."""
    spoken = plain_decimal(spoken_number(c.v, typos, ordinals=True))
    return F.when(c.v.rlike("[A-Za-z]") & ~c.v.rlike(r"\d"), F.coalesce(spoken, c.v)).otherwise(c.v)


def _z_outlier(c, limit=3.0):
    mean, sd = c.stat.get("mean"), c.stat.get("sd")
    return F.abs((c.v - mean) / sd) > limit if sd else F.lit(False)


def _rare_zero(c):
    zeros, n = c.stat.get("zeros") or 0, c.stat.get("n") or 0
    return c.v == 0 if 0 < zeros < 0.05 * n else F.lit(False)


_MOMENTS = dict(mean=lambda c: F.avg(c.v), sd=lambda c: F.stddev_samp(c.v), zeros=lambda c: F.count_if(c.v == 0), n=lambda c: F.count(c.v))


def amount_rules(column):
    never_negative = (_has(column, ("revenue", "sales", "price", "cost", "fee", "amount", "total"))
                      and not _has(column, ("profit", "loss", "adjustment", "change", "difference", "net")))
    r = (ColumnRules(column)
         .derive("AMT-01", "currency", lambda c: currency_of(c.v))
         .measure(first=lambda c: F.min(c.other(f"{column}_currency")), last=lambda c: F.max(c.other(f"{column}_currency")))
         .change("AMT-01", lambda c: without_currency(c.v))
         .change("AMT-02", lambda c: F.when(~is_european(c.v), without_thousands(c.v)).otherwise(c.v))
         .change("AMT-03", lambda c: F.when(is_european(c.v), from_european(c.v)).otherwise(c.v))
         .change("AMT-13", _words_to_number)
         .change("AMT-12", lambda c: F.when(F.trim(c.v).rlike(SCIENTIFIC), F.coalesce(plain_decimal(number(F.trim(c.v)).cast("decimal(38,10)").cast("double")), c.v)).otherwise(c.v))
         .flag("AMT-08", lambda c: (F.trim(c.v) != "") & parse_number(c.v).isNull())
         .change("AMT-08", lambda c: parse_number(c.v))
         .change("AMT-04", lambda c: F.round(c.v, 2))
         .flag("AMT-09", lambda c: c.other(f"{column}_currency").isNotNull() if c.stat.get("first") != c.stat.get("last") else None)
         .measure(**_MOMENTS)
         .flag("AMT-06", _z_outlier)
         .flag("AMT-07", _rare_zero))
    if never_negative:
        r.flag("AMT-05", lambda c: c.v < 0)
    return r


def quantity_rules(column):
    approx = lambda c: (c.v.rlike(APPROX_FRONT) | c.v.rlike(APPROX_BACK)) & c.v.rlike(r"\d")
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c.v), APPROX_FRONT, ""), APPROX_BACK, "")
    whole = lambda c: F.abs(c.v - F.round(c.v))
    return (ColumnRules(column)
            .change("QTY-01", lambda c: _words_to_number(c, {}))
            .change("QTY-02", _words_to_number)
            .flag("QTY-03", lambda c: approx(c) & parse_number(bare(c)).isNotNull())
            .change("QTY-03", lambda c: F.when(approx(c), F.coalesce(parse_number(bare(c)).cast("long").cast("string"), c.v)).otherwise(c.v))
            .derive("QTY-09", "unit", lambda c: F.coalesce(group(F.trim(c.v), NUMBER_THEN_UNIT, 2), group(F.trim(c.v), UNIT_THEN_NUMBER, 1)))
            .change("QTY-09", lambda c: F.coalesce(group(F.trim(c.v), NUMBER_THEN_UNIT, 1), group(F.trim(c.v), UNIT_THEN_NUMBER, 2), c.v))
            .change("QTY-04", lambda c: parse_number(c.v))
            .flag("QTY-04", lambda c: whole(c) >= 0.001)
            .change("QTY-04", lambda c: F.when(whole(c) < 0.001, F.round(c.v)).otherwise(c.v))
            .flag("QTY-05", lambda c: c.v < 0)
            .measure(**_MOMENTS)
            .flag("QTY-06", _z_outlier)
            .flag("QTY-07", _rare_zero))


def percentage_rules(column):
    def spike(c):
        q = c.stat.get("quantiles")
        if not q or q[0] is None:
            return F.lit(False)
        spread = 1.5 * (q[1] - q[0])
        return (c.v < q[0] - spread) | (c.v > q[1] + spread)

    def spoken(c):
        text = F.regexp_replace(F.trim(c.v), r"(?i)\s*(?:percent|pct)$", "")
        return F.when(~c.v.rlike(r"\d"), F.coalesce(plain_decimal(spoken_number(text, AMOUNT_WORD_TYPOS, True)), c.v)).otherwise(c.v)

    r = (ColumnRules(column)
         .change("PCT-01", lambda c: F.trim(F.regexp_replace(F.trim(c.v.cast("string")), r"%+$", "")))
         .change("PCT-06", spoken)
         .change("PCT-01", lambda c: parse_number(c.v))
         .measure(lo=lambda c: F.min(c.v), hi=lambda c: F.max(c.v))
         .change("PCT-03", lambda c: c.v * 100 if c.stat.get("lo") is not None and c.stat["lo"] >= 0 and c.stat["hi"] <= 1 else c.v)
         .measure(quantiles=(0.25, 0.75), n=lambda c: F.count(c.v))
         .flag("PCT-04", spike))
    if not _has(column, ("growth", "change", "increase", "decrease", "yoy", "mom")):
        r.flag("PCT-02", lambda c: ~c.v.between(0, 100))
    return r


def score_scale(lo, hi):
    """SCORE-01, SCORE-04: (name, smallest, largest) of the scale the numbers fit."""
    if lo is None:
        return "unknown", 0, 100
    for name, top in (("gpa_4", 4.0), ("gpa_5", 5.0), ("scale_10", 10), ("scale_100", 100)):
        if lo >= 0 and hi <= top:
            return name, 0, top
    return "custom", lo, hi


def score_rules(column, letters="gpa"):
    """``letters``: map letter grades to grade points (SCORE-03) or to the middle of their percentage band (SCORE-05)."""
    ratio = r"(?i)^([\d.]+)\s*(?:/|out of|of)\s*([\d.]+)$"
    middle = {k: (a + b) / 2 for k, (a, b) in GRADE_BANDS.items()}
    grades = GPA_POINTS if letters == "gpa" else middle

    def rated(c):
        top, base = number(group(F.trim(c.v), ratio, 1)), number(group(F.trim(c.v), ratio, 2))
        return F.when(base > 0, plain_decimal(F.round(top / F.nullif(base, F.lit(0.0)) * 100, 2))).otherwise(c.v)

    def scale(c):
        return score_scale(c.stat.get("lo"), c.stat.get("hi"))

    numeric = lambda c: F.trim(c.v.cast("string")).try_cast("double")
    return (ColumnRules(column)
            .measure(lo=lambda c: F.min(numeric(c)), hi=lambda c: F.max(numeric(c)))
            .note("SCORE-01", lambda s: f"scale {score_scale(s.get('lo'), s.get('hi'))[0]}" if s.get("lo") is not None else None)
            .note("SCORE-04", lambda s: "grade points above 4.0" if s.get("hi") is not None and 4.0 < s["hi"] <= 5.0 else None)
            .change("SCORE-13", lambda c: lookup(GRADE_WORDS, folded(c.v.cast("string")), c.v.cast("string")))
            .change("SCORE-12", rated)
            .change("SCORE-03" if letters == "gpa" else "SCORE-05",
                    lambda c: F.coalesce(plain_decimal(lookup(grades, F.upper(F.trim(c.v)))), c.v))
            .let("number", lambda c: numeric(c))
            .derive("SCORE-10", "value", lambda c: F.round(c.get("number"), 2))
            .flag("SCORE-02", lambda c: (c.get("number") < scale(c)[1]) | (c.get("number") > scale(c)[2])))


def currency_rules(column):
    return (ColumnRules(column)
            .change("CUR-03", lambda c: lookup(CURRENCY_SYMBOLS, F.trim(c.v), c.v))
            .change("CUR-02", lambda c: F.upper(F.trim(c.v)))
            .flag("CUR-01", lambda c: ~c.v.isin(*ISO_4217)))


RANK_WORDS = {**NUMBER_WORDS, **ORDINAL_WORDS, **NUMBER_SCALES}


def rank_rules(column, group_column=None):
    def repeated(frame, v, cur):
        key = F.col(f"`{v}`")
        if group_column:
            key = F.when(key.isNotNull(), F.struct(F.col(f"`{cur.get(group_column, group_column)}`"), key))
        return repeated_rows(frame, v, by=key)

    return (ColumnRules(column)
            .change("RANK-01", lambda c: F.coalesce(group(folded(c.v.cast("string")), r"^(-?\d+)(?:st|nd|rd|th|\.0)?$", 1).try_cast("long"),
                                                    lookup(RANK_WORDS, folded(c.v.cast("string"))).cast("long")))
            .flag("RANK-04", lambda c: c.v <= 0)
            .keyed_flag("RANK-02", repeated))


def missing_ranks(df, column):
    """RANK-03: runs of ranks between 1 and the highest rank that do not occur, as (gap_start, gap_end)."""
    return ordered.integer_gaps(df, column, start=1)


# ---- calculated columns ----------------------------------------------------------------------------------------------

def _formulas(a, b):
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    return [("multiply", x * y), ("add", x + y), ("subtract", x - y), ("divide", x / F.nullif(y, F.lit(0.0)))]


def discover_formula(df, target, columns, tolerance=0.01, least=0.9, at_once=200):
    """CALC-01: the two-column formula that reproduces ``target`` on at least 90 % of its rows.

    All pairs and operators are measured on all rows, ``at_once`` of them in one aggregate, so the plan stays small with many columns.
    """
    t = F.col(f"`{target}`").cast("double")
    candidates = [(a, b, op, e) for a, b in combinations(sorted(c for c in columns if c != target), 2) for op, e in _formulas(a, b)]
    n = df.agg(F.count(t)).first()[0]
    if n < 5 or not candidates:
        return None

    def rates(frame, chosen):
        row = frame.agg(*[x for _, _, op, e in chosen for x in (
            F.count_if(F.abs(e - t) < tolerance), F.count_if(t.isNotNull() if op != "divide" else t.isNotNull() & e.isNotNull()))]).first()
        return [(row[2 * i] / row[2 * i + 1] if row[2 * i + 1] else 0.0) for i in range(len(chosen))]

    chunks = [candidates[i:i + at_once] for i in range(0, len(candidates), at_once)]
    measured = [(r, *c[:3]) for chunk in chunks for c, r in zip(chunk, rates(df, chunk))]
    best = max(measured, key=lambda m: m[0])
    return {"operation": best[3], "left": best[1], "right": best[2], "match_rate": best[0]} if best[0] >= least else None


def calculated_rules(column, formula, tolerance=0.01):
    """CALC-02 flags rows that are off; CALC-03 fills missing ones. ``formula`` comes from ``discover_formula``."""
    expected = dict(_formulas(formula["left"], formula["right"]))[formula["operation"]]
    return (ColumnRules(column)
            .flag("CALC-02", lambda c: F.abs(expected - c.v) > tolerance)
            .flag("CALC-03", lambda c: c.v.isNull() & expected.isNotNull())
            .change("CALC-03", lambda c: F.coalesce(c.v, F.round(expected, 2))))
