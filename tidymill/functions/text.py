"""String expressions shared by the cleaners. Everything here stays inside the JVM."""
from pyspark.sql import functions as F


def _sql_literal(x):
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{x!r}D" if isinstance(x, float) else repr(x)


def lookup(mapping, key, default=None):
    """Value of ``key`` in a small fixed dictionary, else ``default`` (null when not given).

    The dictionary is one constant expression; building it from single literals would cost a call per entry.
    """
    table = F.expr("map(" + ", ".join(_sql_literal(x) for kv in mapping.items() for x in kv) + ")")
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def let(value, fn):
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` mentions it.

    Plain nesting would copy the inner expression at every mention, and again whenever a filter is pushed down.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def folded(v):
    return F.lower(F.trim(v))


def squeeze(v):
    return F.trim(F.regexp_replace(v, r"\s+", " "))


def null_if_in(v, placeholders, key=None):
    key = folded(v) if key is None else key
    return F.when(~key.isin(*placeholders), v)


def word_list(v):
    return F.split(squeeze(v), " ")


def capitalised(w):
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))


def map_words(v, fn):
    return F.array_join(F.transform(word_list(v), fn), " ")


def title_keeping(v, keep=()):
    """Capitalise every word; words in ``keep`` (compared upper-case) stay upper-case."""
    keep = tuple(keep)
    if not keep:
        return map_words(v, capitalised)
    return map_words(v, lambda w: F.when(F.upper(w).isin(*keep), F.upper(w)).otherwise(capitalised(w)))


def title_letters(v):
    """Upper-case every letter that follows a non-letter, lower-case the others (apostrophes and hyphens count)."""
    marked = F.regexp_replace(F.lower(v), r"(^|[^\p{L}])(\p{L})", "$1\u0001$2")
    parts = F.split(marked, "\u0001")
    first = F.element_at(parts, 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(first, F.array_join(F.transform(
        rest, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""))


def is_upper(v):
    return (v == F.upper(v)) & (v != F.lower(v))


def replace_all(v, replacements):
    for old, new in replacements:
        v = F.replace(v, F.lit(old), F.lit(new))
    return v


def group(v, pattern, index):
    """Capture group as string; null when the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(v, pattern, index), F.lit(""))


#: All texts that Spark casts to a double.
NUMERIC = r"(?i)^[\x00-\x20]*[+-]?(?:nan|inf|infinity|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?[0-9]+[df]?|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?[df]?)[\x00-\x20]*$"


def number(v):
    """Double or null. A failed cast throws and catches an exception with its whole stack, so texts that are no numbers are not cast."""
    return let(v.cast("string"), lambda t: F.when(t.rlike(NUMERIC), t.try_cast("double")))


def digits(v):
    return F.regexp_replace(v, r"\D", "")
