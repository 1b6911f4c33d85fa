"""Date, time, date-time, duration and fiscal columns. The reference date is always an argument, never the wall clock."""
from pyspark.sql import functions as F

from ..functions.dates import (SLASHED, day_first_votes, duration_days, duration_unit, parse_date, parse_time, partial_date,
                               relative_date, serial_day)
from ..functions.fixed_values import DATE_PLACEHOLDERS
from ..functions.text import group, null_if_in, number, squeeze
from .rules import ColumnRules, repeated_rows

BIRTH_WORDS = ("dob", "birth", "born")


def _votes(c):
    return day_first_votes(c.v)


def _day_first(c):
    return (c.stat.get("dmy") or 0) >= (c.stat.get("mdy") or 0)


def date_rules(column, reference, historical=True):
    """``reference`` is an ISO date. The column becomes a timestamp; text that is no date becomes null and is flagged."""
    ref = F.lit(reference).cast("date")

    def impossible(c):
        a, b = group(c.raw, SLASHED, 1).try_cast("int"), group(c.raw, SLASHED, 2).try_cast("int")
        return ((a > 12) & (b > 12)) | (a > 31) | (b > 31)

    def form(c):
        return (F.when(c.get("serial").isNotNull(), "DATE-09").when(c.get("relative").isNotNull(), "DATE-14")
                .when(c.get("partial").isNotNull(), "DATE-08").when(F.year(c.get("parsed")).between(1900, 2100), "DATE-01"))

    def typed(c):
        usual = F.when(F.year(c.get("parsed")).between(1900, 2100), c.get("parsed"))
        return F.coalesce(c.get("serial"), c.get("relative"), c.get("partial"), usual)

    def ambiguous(c):
        a, b = group(c.raw, SLASHED, 1).try_cast("int"), group(c.raw, SLASHED, 2).try_cast("int")
        return (a <= 12) & (b <= 12) & (a != b)

    r = (ColumnRules(column)
         .change("DATE-10", lambda c: null_if_in(c.v.cast("string"), DATE_PLACEHOLDERS))
         .measure(dmy=lambda c: _votes(c)[0], mdy=lambda c: _votes(c)[1])
         .let("serial", lambda c: serial_day(c.v)).let("relative", lambda c: relative_date(c.v, ref))
         .let("partial", lambda c: partial_date(c.v)))
    r = (r.let("parsed", lambda c: parse_date(c.v, _day_first(c), int(str(reference)[:4])))
         .derive("DATE-01", "form", form)
         .let("typed", typed)
         .flag("DATE-03", lambda c: impossible(c) | (c.v.isNotNull() & c.get("typed").isNull()))
         .flag("DATE-02", ambiguous)
         .change("DATE-07", lambda c: c.get("typed"))
         .derive("DATE-12", "weekday", lambda c: F.date_format(c.v, "EEEE")))
    if historical:
        r.flag("DATE-04", lambda c: c.v.cast("date") > ref)
    if any(w in column.lower() for w in BIRTH_WORDS):
        r.flag("DATE-05", lambda c: ~(F.datediff(ref, c.v.cast("date")) / 365.25).between(0, 120))
    return r


_ZONE = r"(?i)(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?"


def time_rules(column):
    def written(c):
        t = c.get("clock")
        long = (F.length(c.v) - F.length(F.replace(c.v, F.lit(":"), F.lit(""))) >= 2) | (F.substring(t, 7, 2) != "00")
        return F.coalesce(F.when(long, t).otherwise(F.substring(t, 1, 5)), c.v)

    def bucket(c):
        h = F.substring(c.get("clock"), 1, 2).try_cast("int")
        return (F.when(h.isNull(), F.lit(None)).when(h.between(6, 11), "Morning").when(h.between(12, 16), "Afternoon")
                .when(h.between(17, 20), "Evening").otherwise("Night"))

    return (ColumnRules(column)
            .derive("TIME-04", "timezone", lambda c: F.nullif(F.regexp_extract(c.v, _ZONE, 0), F.lit("")))
            .change("TIME-04", lambda c: F.when(c.v.rlike(_ZONE), F.trim(F.regexp_replace(c.v, rf"{_ZONE}.*$", ""))).otherwise(c.v))
            .let("clock", lambda c: parse_time(c.v))
            .change("TIME-01", lambda c: F.when(F.lower(c.v).rlike(r"[ap]\.?m?\.?$"), written(c)).otherwise(c.v))
            .change("TIME-02", written)
            .derive("TIME-05", "bucket", bucket)
            .flag("TIME-03", lambda c: c.v.rlike(r"^\d{1,2}:\d{1,2}") & (
                (group(c.v, r"^(\d{1,2})", 1).cast("int") > 23) | (group(c.v, r"^\d{1,2}:(\d{1,2})", 1).cast("int") > 59)
                | (F.coalesce(group(c.v, r"^\d{1,2}:\d{1,2}:(\d{1,2})", 1).cast("int"), F.lit(0)) > 59))))


def datetime_rules(column, reference, id_column=None):
    year = int(str(reference)[:4])

    def repeated(frame, v, cur):
        by = F.struct(F.col(f"`{cur.get(id_column, id_column)}`"), F.col(f"`{v}`")) if id_column else F.col(f"`{v}`")
        return repeated_rows(frame, v, by=F.when(F.col(f"`{v}`").isNotNull(), by))

    r = ColumnRules(column).measure(dmy=lambda c: _votes(c)[0], mdy=lambda c: _votes(c)[1])
    return (r.change("DTM-01", lambda c: parse_date(c.v, _day_first(c), year))
            .derive("DTM-03", "iso", lambda c: F.date_format(c.v, "yyyy-MM-dd HH:mm:ss"))
            .derive("DTM-02", "date", lambda c: F.date_format(c.v, "yyyy-MM-dd"))
            .derive("DTM-02", "time", lambda c: F.date_format(c.v, "HH:mm:ss"))
            .derive("DTM-05", "sort_key", lambda c: F.unix_micros(c.v.cast("timestamp")))
            .keyed_flag("DTM-06", repeated))


def duration_rules(column):
    plain = lambda c: number(F.trim(c.v))

    def extreme(c):
        q = c.stat.get("quantiles")
        if not q or q[0] is None or c.stat.get("n", 0) < 10:
            return F.lit(False)
        spread = 3 * (q[1] - q[0])
        return (c.v < q[0] - spread) | (c.v > q[1] + spread)

    return (ColumnRules(column)
            .flag("DUR-07", lambda c: plain(c).isNotNull())
            .derive("DUR-02", "original_unit", lambda c: duration_unit(c.v))
            .change("DUR-01", lambda c: F.coalesce(plain(c), duration_days(c.v)))
            .flag("DUR-04", lambda c: c.v < 0)
            .measure(quantiles=(0.25, 0.75), n=lambda c: F.count(c.v))
            .flag("DUR-06", extreme))


def _pivot_year(y):
    n = y.try_cast("int")
    return F.when(n >= 100, n).when(n < 50, n + 2000).otherwise(n + 1900)


def fiscal_rules(column):
    fy = [r"(?i)^FY\s*(\d{4}|\d{2})$", r"(?i)^(\d{4})\s*FY$", r"(?i)^(?:Financial|Fiscal)\s+Year\s+(\d{4})$"]
    fq = [r"(?i)^Q([1-4])\s*(?:FY)?\s*(\d{4})?$", r"(?i)^Q([1-4])\s*[-/]?\s*FY\s*(\d{2,4})$",
          r"(?i)^([1-4])(?:st|nd|rd|th)?\s+Quarter\s+(\d{4})?$"]
    ay = r"(?i)^(?:AY\s*|Academic\s+Year\s+)?(\d{4})\s*[/-]?\s*(\d{2,4})$"
    ay_ok = r"(?i)^(?:\d{4}\s*[/-]\s*\d{2,4}|(?:AY\s*|Academic\s+Year\s+)\d{4}\s*[/-]?\s*\d{2,4})$"

    def fiscal_year(c):
        t = F.trim(c.v)
        y = F.coalesce(*[group(t, p, 1) for p in fy])
        return F.when(y.isNotNull(), F.concat(F.lit("FY"), _pivot_year(y).cast("string"))).otherwise(c.v)

    def quarter(c):
        q, y = c.get("quarter"), c.get("year")
        return F.when(q.isNotNull(), F.concat_ws(" ", F.concat(F.lit("Q"), q), F.concat(F.lit("FY"), _pivot_year(y).cast("string")))).otherwise(c.v)

    def academic(c):
        t = F.trim(c.v)
        end = F.lpad(F.pmod(group(t, ay, 2).try_cast("int"), F.lit(100)).cast("string"), 2, "0")
        return F.when(t.rlike(ay_ok), F.concat(F.lit("AY "), group(t, ay, 1), F.lit("-"), end)).otherwise(c.v)

    def semester(c):
        t = squeeze(c.v)
        season = r"(?i)^(Spring|Fall|Summer|Winter|Autumn) (\d{4})$"
        name = F.initcap(F.regexp_extract(t, season, 1))
        return (F.when(t.rlike(r"(?i)^Sem(?:ester)? ?1$|^First Semester$"), "Semester 1")
                .when(t.rlike(r"(?i)^Sem(?:ester)? ?2$|^Second Semester$"), "Semester 2")
                .when(t.rlike(r"(?i)^Term ?[1-4]$"), F.concat(F.lit("Term "), F.regexp_extract(t, r"([1-4])$", 1)))
                .when(t.rlike(season), F.concat_ws(" ", F.when(name == "Autumn", "Fall").otherwise(name), F.regexp_extract(t, season, 2)))
                .otherwise(c.v))

    def sort_key(c):
        year = F.coalesce(group(c.v, r"^(?:Q[1-4] )?FY(\d{4})$", 1), group(c.v, r"^AY (\d{4})-\d{2}$", 1)).try_cast("int")
        return year * 10 + F.coalesce(group(c.v, r"^Q([1-4]) FY", 1).try_cast("int"), F.lit(0))

    return (ColumnRules(column).change("FISC-01", fiscal_year)
            .let("quarter", lambda c: F.coalesce(*[group(F.trim(c.v), p, 1) for p in fq]))
            .let("year", lambda c: F.coalesce(*[group(F.trim(c.v), p, 2) for p in fq])).change("FISC-02", quarter).change("FISC-03", academic)
            .change("FISC-04", semester).derive("FISC-05", "sort_key", sort_key)
            .flag("FISC-07", lambda c: c.v.isNull() | (F.trim(c.v) == "")))
