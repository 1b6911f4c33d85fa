"""Dates, times and durations written as text. A fixed list of written forms; anything else is null and flagged."""
from pyspark.sql import functions as F

from .fixed_values import DURATION_SECONDS, NUMBER_WORDS
from .text import group, let, lookup, number, squeeze

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), start=1)}
_MON = "(" + "|".join(MONTHS) + ")[a-z]*"
SLASHED = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
# the accepted written forms of a day, at the start of the text
_FORMS = (r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})|\d{1,2}[ -](?:MON)\.?,?[ -](?:\d{4}|\d{2})"
          r"|(?:MON)\.? \d{1,2},? (?:\d{4}|\d{2})|\d{8})(?:[ t]|$)").replace("MON", "(?:" + "|".join(MONTHS) + ")[a-z]*")


def day_first_votes(v):
    """(votes for day/month, votes for month/day): one aggregate over the whole column."""
    a, b = group(v, SLASHED, 1).try_cast("int"), group(v, SLASHED, 2).try_cast("int")
    return F.count_if((a > 12) & (b <= 12)), F.count_if((b > 12) & (a <= 12))


def full_year(y, reference_year):
    """Two-digit years fall within fifty years of the reference year."""
    n = y.try_cast("int")
    near = n + 2000
    return F.when(F.length(y) == 4, n).when(near >= reference_year + 50, near - 100).otherwise(near)


def date_text(v):
    """Lower case, single spaces, no ordinal endings, no weekday in front."""
    t = F.lower(squeeze(F.regexp_replace(v.cast("string"), r"(?i)\b(\d{1,2})(st|nd|rd|th)\b", "$1")))
    return F.regexp_replace(t, r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")


def clock_text(t):
    """The time of day inside a date text, without fraction and zone."""
    clock = group(t, r"[ t](\d{1,2}:\d{2}.*)$", 1)
    return F.regexp_replace(F.regexp_replace(clock, r"\.\d+", ""), r" ?(z|utc|gmt|[+-]\d{2}:?\d{2})$", "")


def calendar_day(t, day_first, reference_year):
    """'yyyy-MM-dd' of a ``date_text``, not yet checked against the calendar. ``day_first`` settles 03/04/2024."""
    def from_parts(core, parts):
        a, b, c = [F.get(parts, i) for i in (0, 1, 2)]
        named = core.rlike(_MON)
        leads = F.when(named, core.rlike(r"^\d")).otherwise(
            (a.try_cast("int") > 12) | ((b.try_cast("int") <= 12) & F.lit(bool(day_first))))
        join = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return (F.when(core.rlike(r"^\d{8}$"), join(F.substring(core, 1, 4), F.substring(core, 5, 2), F.substring(core, 7, 2)))
                .when(F.length(a) == 4, join(a, b, c))
                .otherwise(let(leads, lambda day: join(full_year(c, reference_year).cast("string"), F.when(day, b).otherwise(a),
                                                       F.when(day, a).otherwise(b)))))

    def from_core(core):
        month = lookup(MONTHS, F.regexp_extract(core, _MON, 1)).cast("string")
        numeric = F.when(core.rlike(_MON), F.regexp_replace(core, F.lit(_MON), month)).otherwise(core)
        return F.when(core != "", let(F.split(numeric, r"[^0-9]+"), lambda parts: from_parts(core, parts)))

    return let(F.regexp_extract(t, _FORMS, 1), from_core)


def parse_date(v, day_first=True, reference_year=2025):
    """Written date or date-time -> timestamp without zone, else null."""
    def from_text(t):
        clock = let(clock_text(t), parse_time)
        return let(calendar_day(t, day_first, reference_year), lambda day: F.when(day.isNotNull(), F.concat_ws(
            " ", day, F.coalesce(clock, F.lit("00:00:00")))))
    return let(date_text(v), from_text).try_cast("timestamp_ntz")


def serial_day(v):
    """Spreadsheet day number 30000 to 60000 -> timestamp."""
    n = F.when(F.trim(v).rlike(r"^\d{5}(\.\d+)?$"), number(F.trim(v)))
    return F.when(n.between(30000, 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int")).cast("timestamp_ntz"))


def partial_date(v):
    """'2023' -> 1 January; '2023-04' -> the first of the month; years 1900 to 2100."""
    t = F.trim(v)
    y, ym = r"^(19\d{2}|20\d{2}|2100)$", r"^((?:19|20)\d{2}|2100)[/-](\d{1,2})$"
    day = F.when(t.rlike(y), F.concat(t, F.lit("-01-01"))).when(
        t.rlike(ym), F.concat_ws("-", F.regexp_extract(t, ym, 1), F.lpad(F.regexp_extract(t, ym, 2), 2, "0"), F.lit("01")))
    return day.try_cast("timestamp_ntz")


def relative_date(v, reference):
    """today, yesterday, tomorrow, N days / weeks / months ago, counted from ``reference`` (a date column)."""
    t = F.lower(F.trim(v))
    n = group(t, r"^(\d+)\s+(day|week|month)s?\s+ago", 1).try_cast("int")
    unit = group(t, r"^(\d+)\s+(day|week|month)s?\s+ago", 2)
    day = (F.when(t == "today", reference).when(t == "yesterday", F.date_sub(reference, 1)).when(t == "tomorrow", F.date_add(reference, 1))
           .when(unit == "day", F.date_sub(reference, n)).when(unit == "week", F.date_sub(reference, n * 7))
           .when(unit == "month", F.add_months(reference, -n)))
    return day.cast("timestamp_ntz")


_TIME = r"^(\d{1,2})(?::(\d{1,2}))?(?::(\d{1,2}))? ?(am|a\.m\.?|a|pm|p\.m\.?|p)?$"


def parse_time(v):
    """'3:05 pm', '15:05', '9:5:7', '3PM' -> 'HH:mm:ss'; null when out of range. An hour alone needs am or pm."""
    def from_text(t):
        h, m, s = [group(t, _TIME, i).try_cast("int") for i in (1, 2, 3)]
        half = F.substring(F.regexp_extract(t, _TIME, 4), 1, 1)
        hour = F.when((half == "p") & (h < 12), h + 12).when((half == "a") & (h == 12), F.lit(0)).otherwise(h)
        parts = F.struct(hour.alias("h"), m.alias("m"), F.coalesce(s, F.lit(0)).alias("s"), half.alias("half"))
        two = lambda x: F.lpad(F.coalesce(x, F.lit(0)).cast("string"), 2, "0")
        return let(parts, lambda p: F.when(
            t.rlike(_TIME) & (p["m"].isNotNull() | (p["half"] != "")) & (p["h"] <= 23) & (F.coalesce(p["m"], F.lit(0)) <= 59) & (p["s"] <= 59),
            F.concat_ws(":", two(p["h"]), two(p["m"]), two(p["s"]))))
    return let(F.lower(squeeze(v)), from_text)


def duration_days(v):
    """'2 weeks 3 days', '1:30', 'two hours' -> days; null when no unit is given."""
    t = F.lower(F.trim(v))
    clock = r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$"
    hms = [F.coalesce(group(t, clock, i).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    units = {u: float(sec) for sec, us in DURATION_SECONDS.items() for u in us}
    names = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    small = {w: float(n) for w, n in {**NUMBER_WORDS, "hundred": 100}.items()}
    found = F.regexp_extract_all(t, F.lit(rf"(\d+(?:\.\d+)?|[a-z]+)\s*({names})\b"), F.lit(0))
    pair = rf"^(\d+(?:\.\d+)?|[a-z]+?)\s*({names})$"

    def seconds(x):
        amount, unit = F.regexp_extract(x, pair, 1), F.regexp_extract(x, pair, 2)
        return F.coalesce(F.coalesce(number(amount), lookup(small, amount)) * lookup(units, unit), F.lit(0.0))

    total = F.aggregate(F.transform(found, seconds), F.lit(0.0), lambda a, x: a + x)
    return F.when(t.rlike(clock), (hms[0] * 3600 + hms[1] * 60 + hms[2]) / 86400.0).when(total > 0, total / 86400.0)


def duration_unit(v):
    """The unit named first in the text."""
    units = {u: us[0] for us in DURATION_SECONDS.values() for u in us}
    names = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    return lookup(units, group(F.lower(F.trim(v)), rf"(?:\d|\b[a-z]+\s)\s*({names})\b", 1))
