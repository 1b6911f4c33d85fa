"""Numbers written as text: currency marks, separators, number words."""
from pyspark.sql import functions as F

from .fixed_values import CURRENCY_PREFIXES, CURRENCY_SYMBOLS, NUMBER_SCALES, NUMBER_WORDS, ORDINAL_WORDS
from .text import group, let, lookup, number

_BARE = r"^[-+\d.,eE]*$"
_DIGITS = r"\A[+-]?[0-9]+(?:\.[0-9]*)?\z"
SCIENTIFIC = r"^[+-]?\d+\.?\d*[eE][+-]?\d+$"


def spoken_number(v, typos, ordinals=False):
    """'one hundred and twenty-five' -> 125.0; null when any word is not a number word."""
    units = {k: float(n) for k, n in {**NUMBER_WORDS, **(ORDINAL_WORDS if ordinals else {})}.items()}
    scales = {k: float(n) for k, n in NUMBER_SCALES.items()}
    tokens = F.filter(F.split(F.regexp_replace(F.lower(F.trim(v)), ",", ""), r"[\s-]+"), lambda t: ~t.isin("", "and"))
    tokens = F.transform(tokens, lambda t: lookup(typos, t, t))

    def step(acc, t):
        scale, unit = lookup(scales, t), lookup(units, t)
        scaled = F.when(acc["current"] == 0, 1.0).otherwise(acc["current"]) * scale
        return F.struct(
            F.when(scale > 100, acc["total"] + scaled).otherwise(acc["total"]).alias("total"),
            F.when(scale > 100, 0.0).when(scale == 100, scaled).otherwise(acc["current"] + F.coalesce(unit, F.lit(0.0)))
            .alias("current"),
            (acc["known"] & (scale.isNotNull() | unit.isNotNull())).alias("known"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("current"), F.lit(True).alias("known"))
    return F.when(F.size(tokens) > 0, F.aggregate(
        tokens, start, step, lambda a: F.when(a["known"], a["total"] + a["current"])))


def _symbols():
    return sorted(CURRENCY_SYMBOLS, key=lambda s: (-len(s), s))


def currency_of(v):
    """ISO code of the first currency mark found at either end (longest symbol first), else null."""
    v = F.trim(v)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for s in _symbols():
        chain = chain.when(F.startswith(v, F.lit(s)) | F.endswith(v, F.lit(s)), F.lit(CURRENCY_SYMBOLS[s]))
    codes = "|".join(CURRENCY_PREFIXES)
    found = F.coalesce(chain, group(F.upper(v), f"^({codes})", 1), group(F.upper(v), f"({codes})$", 1))
    return F.when(~v.rlike(_BARE), found)


def without_currency(v):
    """Remove one currency mark from the front or the back."""
    v = F.trim(v)
    marks = "|".join([s.replace("$", r"\$") for s in _symbols()]) + "|(?i:" + "|".join(CURRENCY_PREFIXES) + ")"
    front = F.regexp_replace(v, f"^(?:{marks})", "")
    # most cells are bare numbers: one cheap test spares them the search for a mark
    return F.when(v.rlike(_BARE), v).otherwise(F.trim(F.when(front != v, front).otherwise(F.regexp_replace(v, f"(?:{marks})$", ""))))


def without_thousands(v):
    return F.regexp_replace(v, r"(?<=\d),(?=\d{3})", "")


def is_european(v):
    """Comma is the decimal mark: it comes after the last period, or it is the only mark before 1-2 final digits."""
    both = F.contains(v, F.lit(".")) & F.contains(v, F.lit(","))
    comma_last = F.instr(F.reverse(v), ",") < F.instr(F.reverse(v), ".")
    return (both & comma_last) | v.rlike(r"^[\d.]+,\d{1,2}$")


def from_european(v):
    return F.translate(v, ",.", ".")


def parse_number(v):
    """Any of '$1,234.50', '1.234,50 EUR', ' 12 % ' -> double, else null."""
    def marked(t):
        plain = F.when(is_european(t), from_european(t)).otherwise(without_thousands(t))
        return number(F.regexp_replace(let(plain, without_currency), r"[^\d.\-+eE]", ""))

    # most cells are bare numbers, which the search for marks and separators leaves as they are
    return let(F.trim(v.cast("string")), lambda t: F.when(t.rlike(_DIGITS), t.try_cast("double")).otherwise(marked(t)))


def plain_decimal(v):
    """Double as text without a trailing '.0'."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")
