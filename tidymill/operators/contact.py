"""Phone, email, address, city, country, postal code and coordinate columns."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions.fixed_values import (DEGREES_PATTERN, PHONE_EXTENSION, PHONE_SEPARATORS, PO_BOX, ADDRESS_PLACEHOLDERS, ADDRESS_WORDS, CITY_SHORT, COUNTRIES, COUNTRY_VARIANTS,
                                      DISPOSABLE_DOMAINS, EMAIL_DOMAIN_TYPOS, EMAIL_PATTERN, EMAIL_PLACEHOLDERS,
                                      PHONE_PLACEHOLDERS, PHONE_SPECS, POSTAL_GENERIC, POSTAL_PATTERNS)
from ..functions.text import (digits, folded, group, is_upper, let, lookup, map_words, null_if_in, number, squeeze, title_letters)
from .rules import ColumnRules, count_nulls, repeated_rows, shared_rows
from .similarity import near, rows_with_value

ISO2_BY_NAME = {**{i2.lower(): i2 for i2, _, _ in COUNTRIES}, **{i3.lower(): i2 for i2, i3, _ in COUNTRIES},
                **{n.lower(): i2 for i2, _, n in COUNTRIES}, **COUNTRY_VARIANTS}
COUNTRY_NAMES = {i2: n for i2, _, n in COUNTRIES}
ISO3 = {i2: i3 for i2, i3, _ in COUNTRIES}


# ---- phone -----------------------------------------------------------------------------------------------------------

def signed_digits(v):
    """Digits, with a leading plus kept."""
    return F.concat(F.when(F.trim(v).startswith("+"), "+").otherwise(""), digits(v))


def phone_list(v):
    return F.filter(F.transform(F.split(F.trim(v), PHONE_SEPARATORS), lambda p: F.trim(p)), lambda p: F.length(signed_digits(p)) >= 7)


def phone_country(v):
    """First country whose calling code starts the number; a code counts with and without the plus."""
    d, chain = digits(v), None
    for country, code, _, _ in PHONE_SPECS:
        hit = d.startswith(code)
        chain = F.when(hit, country) if chain is None else chain.when(hit, country)
    return chain


def _per_country(country, make, default):
    chain = None
    for name, code, lengths, mobile in PHONE_SPECS:
        value = make(code, lengths, mobile)
        chain = F.when(country == name, value) if chain is None else chain.when(country == name, value)
    return chain.otherwise(default)


def national_number(v, country):
    d = digits(v)
    return _per_country(country, lambda code, *_: F.regexp_replace(d, f"^{code}", ""), d)


def e164(v, country):
    code = _per_country(country, lambda code, *_: F.lit(code), F.lit(""))
    return F.concat(F.lit("+"), code, national_number(v, country))


def phone_length_ok(v, country):
    n = F.length(national_number(v, country))
    return _per_country(country, lambda code, lengths, _: n.isin(*lengths), F.length(digits(v)).between(7, 15))


def phone_kind(v, country):
    """Mobile or Landline where the country has mobile prefixes."""
    rest = national_number(v, country)
    def kind(code, lengths, mobile):
        if not mobile:
            return F.lit(None).cast("string")
        return F.when(rest.rlike("^(" + "|".join(mobile) + ")"), "Mobile").otherwise("Landline")
    return _per_country(country, kind, F.lit(None).cast("string"))


def phone_rules(column, default_country="US", id_column=None):
    def no_placeholder(c):
        return let(c.v.cast("string"), lambda v: F.when(~(folded(v).isin(*PHONE_PLACEHOLDERS) | signed_digits(v).isin(*PHONE_PLACEHOLDERS)
                                                          | digits(v).rlike(r"^(\d)\1{6,}$")), v))

    def shared(frame, v, cur):
        return shared_rows(frame, v, cur.get(id_column, id_column)) if id_column else repeated_rows(frame, v)

    several = lambda c: F.size(phone_list(c.raw))
    return (ColumnRules(column)
            .measure(multi=lambda c: F.count_if(several(c) >= 2), any=lambda c: F.count_if(several(c) >= 1))
            .change("PHONE-07", no_placeholder)
            .derive("PHONE-02", "primary", lambda c: F.when(F.size(phone_list(c.v)) >= 2, F.get(phone_list(c.v), 0)))
            .derive("PHONE-02", "secondary", lambda c: F.get(phone_list(c.v), 1))
            .change("PHONE-02", lambda c: F.coalesce(c.other(f"{column}_primary"), c.v))
            .derive("PHONE-08", "extension", lambda c: group(c.v, PHONE_EXTENSION, 1))
            .change("PHONE-08", lambda c: F.trim(F.regexp_replace(c.v, PHONE_EXTENSION, "")))
            .change("PHONE-03", lambda c: F.nullif(signed_digits(c.v), F.lit("")))
            .let("country", lambda c: phone_country(c.v))
            .change("PHONE-04", lambda c: F.when(c.get("country").isNull() & c.v.isNotNull(), e164(c.v, F.lit(default_country))).otherwise(c.v))
            .let("known", lambda c: F.coalesce(c.get("country"), F.lit(default_country)))
            .change("PHONE-09", lambda c: F.when(c.v.isNotNull(), e164(c.v, c.get("known"))))
            .derive("PHONE-11", "type", lambda c: F.when(c.v.isNotNull(), phone_kind(c.v, c.get("known"))))
            .flag("PHONE-05", lambda c: ~phone_length_ok(c.v, c.get("known")))
            .flag("PHONE-10", lambda c: c.v.isNull())
            .keyed_flag("PHONE-06", shared)
            .note("PHONE-01", lambda s: "most rows hold several numbers" if s.get("any") and s["multi"] >= 0.5 * s["any"] else None))


# ---- email -----------------------------------------------------------------------------------------------------------

def email_list(v):
    return F.filter(F.split(F.trim(v), r"[,;\s]+"), lambda e: F.contains(e, F.lit("@")))


def email_rules(column):
    domain = lambda c: F.lower(F.substring_index(c.v, "@", -1))
    has_at = lambda c: F.contains(c.v, F.lit("@"))
    suggested = lambda c: F.when(has_at(c), lookup(EMAIL_DOMAIN_TYPOS, domain(c)))
    return (ColumnRules(column)
            .let("all", lambda c: email_list(c.v))
            .derive("EMAIL-09", "secondary", lambda c: F.lower(F.get(c.get("all"), 1)))
            .change("EMAIL-09", lambda c: F.when(F.size(c.get("all")) >= 2, F.get(c.get("all"), 0)).otherwise(c.v))
            .change("EMAIL-06", lambda c: F.regexp_replace(c.v, r"\s+", ""))
            .change("EMAIL-07", lambda c: null_if_in(c.v, EMAIL_PLACEHOLDERS))
            .change("EMAIL-01", lambda c: F.nullif(F.lower(c.v), F.lit("")))
            .flag("EMAIL-02", lambda c: ~c.v.rlike(EMAIL_PATTERN))
            .flag("EMAIL-03", lambda c: has_at(c) & (F.length(F.substring_index(domain(c), ".", -1)) < 2))
            .flag("EMAIL-05", lambda c: has_at(c) & domain(c).isin(*DISPOSABLE_DOMAINS))
            .flag("EMAIL-08", lambda c: c.v.isNull())
            .derive("EMAIL-10", "suggestion", lambda c: F.when(suggested(c).isNotNull(), F.concat(
                F.substring_index(c.v, "@", 1), F.lit("@"), suggested(c))))
            .flag("EMAIL-10", lambda c: c.other(f"{column}_suggestion").isNotNull())
            .keyed_flag("EMAIL-04", lambda frame, v, cur: repeated_rows(frame, v, by=F.lower(F.trim(F.col(f"`{v}`"))))))


# ---- address ---------------------------------------------------------------------------------------------------------


def address_rules(column):
    expand = lambda v: reduce(lambda x, kv: F.regexp_replace(x, rf"(?i)\b{kv[0]}\b\.?", kv[1]), ADDRESS_WORDS.items(), v)
    cased = lambda v: map_words(v, lambda w: F.when((F.length(w) <= 3) & is_upper(w), w).otherwise(title_letters(w)))
    # every row is looked at; ten samples would do no better
    complex_address = lambda c: F.contains(c.v, F.lit(",")) | (F.size(F.split(squeeze(c.v), " ")) > 5)
    return (ColumnRules(column)
            .change("ADDR-04", lambda c: null_if_in(c.v, ADDRESS_PLACEHOLDERS))
            .change("ADDR-01", lambda c: squeeze(c.v))
            .change("ADDR-02", lambda c: expand(c.v))
            .change("ADDR-05", lambda c: cased(c.v))
            .measure(complex=lambda c: F.count_if(complex_address(c)))
            .flag("ADDR-06", lambda c: c.v.isNull() | (c.v == ""))
            .flag("ADDR-07", lambda c: c.v.rlike(PO_BOX))
            .note("ADDR-03", lambda s: "addresses could be split into parts" if s.get("complex") else None))


def address_parts(df, column, n=3):
    """ADDR-03: the comma-separated parts of an address as columns."""
    parts = F.transform(F.split(F.col(column), ","), lambda p: F.trim(p))
    return df.select("*", *[F.get(parts, i).alias(f"{column}_part{i + 1}") for i in range(n)])


# ---- city, country, postal code ----------------------------------------------------------------------------------------

def normal_city(v):
    return F.coalesce(lookup(CITY_SHORT, folded(v)), title_letters(F.trim(v)))


def misspelt_singletons(frame, column, rid="_rid"):
    """CITY-02: rows whose value occurs once and lies within two edits of a value that occurs more often."""
    folded_rows = frame.select(F.col(rid).alias("_rid"), F.lower(F.col(f"`{column}`")).alias("value")).filter("value is not null and value <> ''")
    counts = folded_rows.groupBy("value").agg(F.count("*").alias("n"))
    lone = near(counts.filter("n = 1").select("value"), counts.filter("n > 1").select("value"))
    return rows_with_value(folded_rows.withColumnRenamed("_rid", rid), "value", lone, rid)


def city_rules(column, address_column=None):
    r = (ColumnRules(column)
         .change("CITY-03", lambda c: lookup(CITY_SHORT, folded(c.v), c.v))
         .change("CITY-01", lambda c: title_letters(F.trim(c.v)))
         .change("CITY-05", lambda c: normal_city(c.v))
         .keyed_flag("CITY-02", lambda frame, v, cur: misspelt_singletons(frame, v)))
    if address_column:
        r.flag("CITY-06", lambda c: (c.v.isNull() | (c.v == "")) & c.other(address_column).isNotNull())
    return r


def iso2_of(v):
    return lookup(ISO2_BY_NAME, folded(v))


def close_country(v, distance=2):
    """ISO-2 code of the first country whose name is within ``distance`` edits. Compared with the fixed list only."""
    names = F.array(*[F.lit(n.lower()) for _, _, n in COUNTRIES])
    codes = F.array(*[F.lit(i2) for i2, _, _ in COUNTRIES])
    near_it = F.transform(names, lambda n: F.levenshtein(folded(v), n, distance).between(0, distance))
    at = F.array_position(near_it, True)
    return F.when(at > 0, F.get(codes, at.cast("int") - 1))


def top_value(frame, column):
    """Most frequent non-null value, its rows, and all non-null rows: counted by key, three numbers come back."""
    counts = frame.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))


def country_rules(column, output="name"):
    shown = {"name": COUNTRY_NAMES, "iso2": {k: k for k in ISO3}, "iso3": ISO3}[output]
    r = (ColumnRules(column)
         .change("CNTRY-03", lambda c: F.coalesce(lookup(COUNTRY_NAMES, lookup(COUNTRY_VARIANTS, folded(c.v))), c.v))
         .change("CNTRY-01", lambda c: F.coalesce(lookup(shown, iso2_of(c.v)), c.v)))
    if output == "name":
        r.change("CNTRY-04", lambda c: title_letters(F.trim(c.v)))
    return (r.let("known", lambda c: iso2_of(c.v))
            .let("close", lambda c: F.when(c.get("known").isNull() & c.v.isNotNull(), close_country(c.v)))
            .flag("CNTRY-02", lambda c: c.get("close").isNotNull())
            .flag("CNTRY-05", lambda c: c.v.isNotNull() & c.get("known").isNull() & c.get("close").isNull()))


def dominant_value(df, column, share=0.8):
    """CNTRY-06: the value to suggest for missing rows, when one value holds at least ``share`` of the others."""
    nulls = df.agg(F.count_if(F.col(column).isNull()).alias("n_missing"))
    from ..plans.facts import attach
    return (attach(top_value(df, column), nulls).filter((F.col("n") >= share * F.col("total")) & (F.col("n_missing") > 0))
            .select(F.col("value").alias("suggestion"), F.round(F.col("n") / F.col("total") * 100, 1).alias("share_pct"), "n_missing"))


def postal_rules(column, country_column=None, country=None):
    def where(c):
        if country:
            return F.lit(country)
        return iso2_of(c.other(country_column)) if country_column else F.lit(None).cast("string")

    def valid(c):
        t, chain = F.trim(c.v), None
        for iso2, pattern in POSTAL_PATTERNS.items():
            chain = F.when(c.get("country") == iso2, t.rlike(pattern)) if chain is None else chain.when(c.get("country") == iso2, t.rlike(pattern))
        return chain.otherwise(t.rlike(POSTAL_GENERIC))

    return (ColumnRules(column)
            .let("country", where)
            .change("POST-01", lambda c: F.when(c.v.cast("string").rlike(r"^\d{1,4}(\.0)?$"), F.lpad(F.regexp_replace(c.v.cast("string"), r"\.0$", ""), 5, "0"))
                    .otherwise(c.v.cast("string")))
            .change("POST-03", lambda c: F.when(F.length(digits(c.v)) == 9, F.concat_ws("-", F.substring(digits(c.v), 1, 5), F.substring(digits(c.v), 6, 4))).otherwise(c.v))
            .flag("POST-02", lambda c: ~valid(c))
            .flag("POST-04", lambda c: c.v.rlike("[A-Za-z]") & ~F.coalesce(c.get("country").isin("GB", "CA", "NL", "IE"), F.lit(False))))


# ---- coordinates -------------------------------------------------------------------------------------------------------


def dms_to_decimal(v):
    t = F.trim(v)
    part = lambda i: F.coalesce(number(F.regexp_extract(t, DEGREES_PATTERN, i)), F.lit(0.0))
    sign = F.when(F.upper(F.regexp_extract(t, DEGREES_PATTERN, 4)).isin("S", "W"), -1).otherwise(1)
    return F.when(t.rlike(DEGREES_PATTERN), F.round(sign * (part(1) + part(2) / 60 + part(3) / 3600), 6))


def coordinate_rules(column, paired_with=None, decimals=6):
    name = column.lower()
    limit = 90 if "lat" in name else 180
    r = (ColumnRules(column)
         .flag("GEO-05", lambda c: c.v.isNull())
         .let("text", lambda c: c.v.cast("string"))
         .change("GEO-02", lambda c: F.coalesce(number(F.trim(c.get("text"))), dms_to_decimal(c.get("text"))))
         .change("GEO-04", lambda c: F.round(c.v, decimals))
         .flag("GEO-01", lambda c: (F.abs(c.v) > limit) | (c.v.isNull() & c.get("text").isNotNull())))
    if paired_with:
        other = lambda c: number(c.other(paired_with).cast("string"))
        r.flag("GEO-06", lambda c: (F.abs(c.v) > 90) & (F.abs(other(c)) <= 90))
    return r
