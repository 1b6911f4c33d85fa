"""Missing values: filled where other columns determine them, suggested where neighbours hint at them, else left and marked."""
from functools import reduce

from pyspark.sql import functions as F

from ..functions.fixed_values import CITY_COUNTRIES, REFUSAL_WORDS
from ..functions.text import folded, lookup
from ..plans import ordered
from .validation import age_on


def _c(n):
    return F.col(f"`{n}`")


def _blank(n):
    return _c(n).isNull() | (F.trim(_c(n).cast("string")) == "")


def _num(n):
    return F.trim(_c(n).cast("string")).try_cast("double")


def _day(n):
    return _c(n).cast("string").try_cast("date")


def fill_rules(b, as_of=None, fiscal_start=1):
    """[(scenario, target column, value)] that are filled at once. ``b`` names columns by their part."""
    has = lambda *ks: all(k in b for k in ks)
    out = []
    if has("age", "birth_date"):
        a = age_on(_day(b["birth_date"]), F.lit(as_of).cast("date"))
        out.append(("MV-AGE", b["age"], F.when(a.between(0, 150), a)))
    if has("full_name", "name_parts"):
        out.append(("MV-NAME", b["full_name"], F.nullif(F.concat_ws(" ", *[F.trim(_c(p)) for p in b["name_parts"]]), F.lit(""))))
    if has("amount", "quantity", "price"):
        out.append(("MV-AMOUNT", b["amount"], F.round(_num(b["quantity"]) * _num(b["price"]), 2)))
    if has("percent", "numerator", "denominator"):
        out.append(("MV-PCT", b["percent"], F.round(F.try_divide(_num(b["numerator"]), _num(b["denominator"])) * 100, 2)))
    if has("duration", "start", "end"):
        out.append(("MV-DUR", b["duration"], F.datediff(_day(b["end"]), _day(b["start"]))))
    if has("country", "city"):
        out.append(("MV-COUNTRY", b["country"], lookup(CITY_COUNTRIES, folded(_c(b["city"])))))
    if has("fiscal_year", "date"):
        out.append(("MV-FY", b["fiscal_year"], F.year(_day(b["date"])) - F.when(F.month(_day(b["date"])) < fiscal_start, 1).otherwise(0)))
    if has("grade_average", "scores"):
        w = b.get("weights") or [1.0] * len(b["scores"])
        known = lambda s, x: F.when(_num(s).isNotNull(), x)
        total = reduce(lambda x, y: x + y, [F.coalesce(_num(s) * k, F.lit(0.0)) for s, k in zip(b["scores"], w)])
        weight = reduce(lambda x, y: x + y, [F.coalesce(known(s, F.lit(float(k))), F.lit(0.0)) for s, k in zip(b["scores"], w)])
        out.append(("MV-GPA", b["grade_average"], F.round(F.try_divide(total, F.nullif(weight, F.lit(0.0))), 2)))
    return out


def resolve_missing(df, bindings, as_of=None, fiscal_start=1):
    """The table with determined values filled, and ``filled``: the scenarios applied to the row.

    A refusal in the gender column is an answer, not a gap (MV-GENDER).
    """
    rules = fill_rules(bindings, as_of, fiscal_start)
    types = dict(df.dtypes)
    new = {target: F.when(_blank(target), F.coalesce(value.cast(types[target]), _c(target))).otherwise(_c(target)) for _, target, value in rules}
    applied = [F.when(_blank(target) & value.isNotNull(), F.lit(s)) for s, target, value in rules]
    g = bindings.get("gender")
    if g:
        new[g] = F.when(folded(_c(g)).isin(*REFUSAL_WORDS), F.lit("Prefer Not to Say")).otherwise(_c(g))
        applied.append(F.when(folded(_c(g)).isin(*REFUSAL_WORDS) & (_c(g) != "Prefer Not to Say"), F.lit("MV-GENDER")))
    return df.select(*[new[c].alias(c) if c in new else _c(c) for c in df.columns], F.concat_ws(",", *applied).alias("filled"))


def resolve_missing_audited(df, bindings, as_of=None, fiscal_start=1, rid="_rid"):
    """The table of ``resolve_missing``, and one line per filled cell: rule, column, _rid, old_value, new_value."""
    types, lines, new = dict(df.dtypes), [], {}
    def note(rule, c, when, value):
        return F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), _c(c).cast("string").alias("old_value"), value.cast("string").alias("new_value")))
    for rule, target, value in fill_rules(bindings, as_of, fiscal_start):
        value = value.cast(types[target])
        lines.append(note(rule, target, _blank(target) & value.isNotNull(), value))
        new[target] = F.when(_blank(target), F.coalesce(value, _c(target))).otherwise(_c(target))
    g = bindings.get("gender")
    if g and types[g] == "string":
        refused = folded(_c(g)).isin(*REFUSAL_WORDS)
        lines.append(note("MV-GENDER", g, refused & (_c(g) != "Prefer Not to Say"), F.lit("Prefer Not to Say")))
        new[g] = F.when(refused, F.lit("Prefer Not to Say")).otherwise(_c(g))
    if not lines:
        return df, None
    staged = df.select(*[new[c].alias(c) if c in new else _c(c) for c in df.columns], F.array_compact(F.array(*lines)).alias("_fills"))
    return staged.drop("_fills"), staged.select(F.col(rid).alias("_rid"), F.inline("_fills"))


def city_from_address(df, address, city):
    """MV-CITY: suggested city, the last but one comma-separated part of the address."""
    part = F.trim(F.try_element_at(F.split(_c(address), ","), F.lit(-2)))
    return df.withColumn(f"{city}_suggestion", F.when(_blank(city), F.nullif(part, F.lit(""))))


def between_neighbours(df, order_cols, columns):
    """MV-DATE, MV-QTY: suggestion for a gap: the middle of the nearest earlier and later value (whole days for dates)."""
    types = dict(df.dtypes)
    paired = ordered.neighbours(df, order_cols, columns)
    def middle(c):
        a, b = F.col(f"`{c}_prev`"), F.col(f"`{c}_next`")
        if types[c].startswith(("date", "timestamp")):
            a, b = a.cast("date"), b.cast("date")
            return F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))
        return (a + b) / 2
    return paired.select(*[_c(c) for c in df.columns], *[F.when(_c(c).isNull(), middle(c)).alias(f"{c}_suggestion") for c in columns])


_SEQUENCE = r"^(.*?)(\d+)$"


def next_in_sequence(df, order_cols, column):
    """MV-SEQ: suggestion for missing ids when the ids before them rise by one constant step under one prefix."""
    number, prefix = F.regexp_extract(_c(column).cast("string"), _SEQUENCE, 2).try_cast("long"), F.regexp_extract(_c(column).cast("string"), _SEQUENCE, 1)
    base = df.withColumn("_n", number).withColumn("_p", prefix).withColumn("_w", F.length(F.regexp_extract(_c(column).cast("string"), _SEQUENCE, 2)))
    paired = ordered.neighbours(base, order_cols, ["_n", "_p", "_w"], following=False)
    step = F.col("_n") - F.col("_n_prev")
    facts = paired.agg(F.min(step), F.max(step), F.min(F.when(_c(column).isNotNull(), F.col("_p"))), F.max(F.when(_c(column).isNotNull(), F.col("_p")))).first()
    drop = ["_n", "_p", "_w", "_n_prev", "_p_prev", "_w_prev"]
    # a gap widens the step from the row before it to the row after it, so the smallest step is the step of the sequence
    steady = facts[0] is not None and facts[0] > 0 and facts[1] % facts[0] == 0 and facts[2] == facts[3]
    guess = F.concat(F.col("_p_prev"), F.lpad((F.col("_n_prev") + (facts[0] or 0)).cast("string"), F.greatest(F.col("_w_prev"), F.length((F.col("_n_prev") + (facts[0] or 0)).cast("string"))), "0"))
    return paired.withColumn(f"{column}_suggestion", F.when(_c(column).isNull(), guess) if steady else F.lit(None).cast("string")).drop(*drop)


def summary(resolved, original_nulls, columns):
    """MV-SUMMARY: per column: missing before, filled, still missing (MV-PROMPT: these need a person)."""
    after = resolved.agg(*[F.count_if(_blank(c)) for c in columns]).first()
    rows = [(c, int(original_nulls[c]), int(original_nulls[c] - after[i]), int(after[i])) for i, c in enumerate(columns)]
    return resolved.sparkSession.createDataFrame(rows, "column string, missing bigint, filled bigint, remaining bigint")


def missing_counts(df, columns):
    row = df.agg(*[F.count_if(_blank(c)) for c in columns]).first()
    return dict(zip(columns, row))


def scenario_counts(resolved):
    """MV-SUMMARY: rows per applied scenario."""
    return (resolved.select(F.explode(F.split("filled", ",")).alias("scenario")).filter("scenario <> ''").groupBy("scenario").agg(F.count("*").alias("n")))


def prompts(df, columns, rid="_rid"):
    """MV-PROMPT: rows and columns that still need a person."""
    gaps = F.array_compact(F.array(*[F.when(_blank(c), F.lit(c)) for c in columns]))
    return df.select(F.col(rid).alias("_rid"), F.explode(gaps).alias("column"))
