"""Diagnosis and physical measurement columns."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions.fixed_values import (BMI_BANDS, BODY_RANGES, ICD10, ICD11, MEDICAL_SHORT, MEDICAL_TYPOS, TITLE_SMALL_WORDS, TO_CM, TO_KG)
from ..functions.numbers import plain_decimal
from ..functions.text import capitalised, folded, let, lookup, number, word_list
from .rules import ColumnRules

_ROMAN = r"(?i)^(?:X{0,1}(?:IX|IV|V?I{0,3}))$"
_SHORT = {**MEDICAL_SHORT}


def diagnosis_case(v):
    def word(w, i):
        return (F.when(w.rlike(_ROMAN), F.upper(w)).when((i > 0) & F.lower(w).isin(*TITLE_SMALL_WORDS), F.lower(w)).otherwise(capitalised(w)))
    return F.array_join(F.transform(word_list(v), word), " ")


def expand_short(v):
    """The whole value, else each word, is looked up; punctuation around a word is ignored in the lookup."""
    whole = lookup(_SHORT, F.upper(F.trim(v)))
    by_word = F.array_join(F.transform(word_list(v), lambda w: lookup(_SHORT, F.upper(F.regexp_replace(w, r"\W", "")), w)), " ")
    some = F.exists(word_list(v), lambda w: lookup(_SHORT, F.upper(F.regexp_replace(w, r"\W", ""))).isNotNull())
    return F.coalesce(whole, F.when(some, by_word), v)


def suggested_spelling(v):
    """Correction for the first misspelling contained in the text."""
    t = F.lower(v)
    return reduce(lambda acc, kv: acc.when(F.contains(t, F.lit(kv[0])), F.lit(kv[1])), list(MEDICAL_TYPOS.items())[1:],
                  F.when(F.contains(t, F.lit(next(iter(MEDICAL_TYPOS)))), F.lit(next(iter(MEDICAL_TYPOS.values())))))


def diagnosis_rules(column):
    several = lambda v: F.size(F.filter(F.split(v, r"[,;/&\n]| and "), lambda p: F.length(F.trim(p)) > 1)) > 1
    return (ColumnRules(column)
            .change("DIAG-01", lambda c: F.when((c.v == F.lower(c.v)) & (F.trim(c.v) != ""), diagnosis_case(c.v)).otherwise(c.v))
            .flag("DIAG-02", lambda c: F.trim(c.v).rlike(r"(?i)^[A-Z]\d") & ~F.trim(c.v).rlike(ICD10) & ~F.trim(c.v).rlike(ICD11))
            .change("DIAG-03", lambda c: expand_short(c.v))
            .derive("DIAG-04", "suggestion", lambda c: suggested_spelling(c.v))
            .flag("DIAG-04", lambda c: c.other(f"{column}_suggestion").isNotNull())
            .flag("DIAG-06", lambda c: c.v.isNull() | (F.trim(c.v) == ""))
            .flag("DIAG-07", lambda c: several(c.v))
            .note("DIAG-05", lambda s: "high-sensitivity medical data: restrict export, encrypt, log access"))


_KIND_WORDS = (("weight", ("weight", "mass", "wt")), ("height", ("height", "ht", "tall")), ("temperature", ("temp",)),
               ("pressure", ("bp", "pressure")), ("pulse", ("pulse", "heart_rate", "hr", "bpm")), ("bmi", ("bmi",)))
_UNITS = {
    "weight": [("kg", r"kilograms?|kgs?"), ("lb", r"pounds?|lbs?"), ("g", r"grams?|g"), ("oz", r"ounces?|oz"), ("st", r"stones?|st")],
    "height": [("cm", r"centimeters?|cms?"), ("m", r"meters?|metres?|m"), ("in", r"inch(?:es)?|in"), ("ft", r"foot|feet|ft")],
    "temperature": [("C", r"°?\s*(?:celsius|c)"), ("F", r"°?\s*(?:fahrenheit|f)")],
    "pressure": [("mmHg", r"/\s*\d{2,3}")], "pulse": [("bpm", r"bpm|beats?\s*per\s*min")], "bmi": [],
}


def measurement_kind(column):
    return next((k for k, ws in _KIND_WORDS if any(w in column.lower() for w in ws)), None)


def unit_of(v, kind):
    forms = [x for k in ([kind] if kind in _UNITS else ["weight", "height", "temperature"]) for x in _UNITS[k]]
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for unit, words in forms:
        chain = chain.when(v.rlike(rf"(?i)\d\s*(?:{words})(?![a-z])"), F.lit(unit))
    return chain


def measurement_rules(column, decimals=1):
    """Numbers come out in kg, cm or degrees Celsius."""
    kind = measurement_kind(column)
    feet = r"""^(\d+)\s*['′]\s*(\d+(?:\.\d+)?)\s*["″]?"""
    first = lambda v: number(F.regexp_extract(v, r"(\d+(?:\.\d+)?)", 1))

    def imperial(c):
        t = F.trim(c.v.cast("string"))
        ft = number(F.regexp_extract(t, feet, 1)) * 30.48 + number(F.regexp_extract(t, feet, 2)) * 2.54
        return plain_decimal(F.when(t.rlike(feet), F.round(ft, 1))
                             .when(t.rlike(r"(?i)^\d+(\.\d+)?\s*(lb|lbs|pound|pounds)(?![a-z])"), F.round(first(t) * TO_KG["lb"], 2))
                             .when(t.rlike(r"(?i)^\d+(\.\d+)?\s*°?\s*F(?![a-z])|^\d+(\.\d+)?\s*°?\s*fahrenheit"), F.round((first(t) - 32) * 5 / 9, 1)))

    def metric(c):
        v, unit = first(c.v), c.get("unit")
        table = {"weight": TO_KG, "height": TO_CM}.get(kind, {})
        scaled = lookup(table, unit) * v if table else F.lit(None).cast("double")
        if kind == "temperature":
            scaled = F.when(unit == "F", (v - 32) * 5 / 9)
        return F.coalesce(plain_decimal(F.round(scaled, 1)), c.v)

    r = (ColumnRules(column)
         .derive("PHYS-01", "unit", lambda c: F.when(F.trim(c.v.cast("string")).rlike(feet), "in").otherwise(unit_of(c.v.cast("string"), kind)))
         .flag("PHYS-08", lambda c: c.v.isNull() | (F.trim(c.v.cast("string")) == ""))
         .change("PHYS-03", lambda c: F.coalesce(imperial(c), c.v.cast("string")))
         .let("unit", lambda c: unit_of(c.v, kind))
         .change("PHYS-02", metric))
    if kind != "pressure":
        # what remains is one number, with or without a metric unit behind it
        r.change("PHYS-07", lambda c: F.round(number(F.regexp_extract(F.trim(c.v), r"^(-?\d+(?:\.\d+)?)", 1)), decimals))
        if kind in BODY_RANGES:
            r.flag("PHYS-04", lambda c: ~c.v.between(*BODY_RANGES[kind]))
    else:
        part = lambda c, i: F.regexp_extract(c.v, r"(\d{2,3})\s*/\s*(\d{2,3})", i).try_cast("int")
        r.flag("PHYS-04", lambda c: ~part(c, 1).between(*BODY_RANGES["systolic"]) | ~part(c, 2).between(*BODY_RANGES["diastolic"]))
    return r


def add_bmi(df, weight, height, out="bmi"):
    """PHYS-05, PHYS-06: body mass index from kg and cm, kept between 10 and 80, and its band."""
    w, h = F.col(weight), F.col(height)
    bmi = F.when((w > 0) & (h > 0), w / F.pow(h / 100, F.lit(2)))
    kept = df.select("*", bmi.alias("_bmi")).select(*df.columns, F.when(F.col("_bmi").between(*BODY_RANGES["bmi"]), F.round("_bmi", 1)).alias(out))
    band = reduce(lambda acc, b: acc.when(F.col(out) < b[0], F.lit(b[1])), BMI_BANDS[1:], F.when(F.col(out) < BMI_BANDS[0][0], F.lit(BMI_BANDS[0][1])))
    return kept.select("*", F.when(F.col(out).isNotNull(), band.otherwise("Obese")).alias(f"{out}_category"))
