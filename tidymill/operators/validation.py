"""Cross-column and cross-table checks. Row checks are boolean columns of one projection; key checks are joins."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (ACTIVE_WORDS, CALLING_CODES, COMPLETED_WORDS, FAIL_WORDS, INACTIVE_WORDS, PAID_WORDS, PASS_WORDS, TITLE_GENDERS)
from ..functions.text import digits, folded, lookup

COLUMNS = "rule string, column string, _rid bigint, value string"


def _c(name):
    return F.col(f"`{name}`")


def _text(name):
    return folded(_c(name).cast("string"))


def _number(name):
    return F.trim(_c(name).cast("string")).try_cast("double")


def _date(name):
    return _c(name).cast("string").try_cast("date")


def age_on(born, as_of):
    """Completed years."""
    return F.floor(F.months_between(as_of, born) / 12).cast("int")


def row_checks(b, as_of=None):
    """[(rule, columns, condition)] for the bound columns. ``b`` names columns by their part in a check; ``as_of`` is an ISO date."""
    has = lambda *ks: all(k in b for k in ks)
    out = []
    if has("status", "completed_date"):
        out.append(("COND-01", (b["status"], b["completed_date"]), _text(b["status"]).isin(*COMPLETED_WORDS) & _c(b["completed_date"]).isNull()))
    if has("status", "paid_amount"):
        n = _number(b["paid_amount"])
        out.append(("COND-02", (b["status"], b["paid_amount"]), _text(b["status"]).isin(*PAID_WORDS) & (n.isNull() | (n <= 0))))
    if has("dates"):
        ordered = [_date(d) for d in b["dates"]]
        out.append(("COND-03", tuple(b["dates"]), reduce(lambda x, y: x | y, [F.coalesce(p > q, F.lit(False)) for p, q in zip(ordered, ordered[1:])])))
    if has("age", "birth_date"):
        out.append(("COND-05", (b["age"], b["birth_date"]), F.abs(_number(b["age"]) - age_on(_date(b["birth_date"]), F.lit(as_of).cast("date"))) > 1))
    if has("score", "result"):
        s, r, at = _number(b["score"]), _text(b["result"]), b.get("pass_at", 40)
        out.append(("COND-06", (b["score"], b["result"]), ((s >= at) & r.isin(*FAIL_WORDS)) | ((s < at) & r.isin(*PASS_WORDS))))
    if has("title", "gender"):
        g = F.when(_text(b["gender"]).isin("male", "m", "man", "boy"), "male").when(_text(b["gender"]).isin("female", "f", "woman", "girl"), "female")
        out.append(("COND-07", (b["title"], b["gender"]), lookup(TITLE_GENDERS, _text(b["title"])) != g))
    if has("country", "phone"):
        phone = F.trim(_c(b["phone"]).cast("string"))
        dialled = F.when(phone.startswith("+"), digits(phone)).when(phone.startswith("00"), F.substring(digits(phone), 3, 30))
        out.append(("COND-08", (b["country"], b["phone"]), ~dialled.startswith(lookup(CALLING_CODES, _text(b["country"])))))
    if has("quantity", "amount"):
        out.append(("COND-09", (b["quantity"], b["amount"]), F.signum(_number(b["quantity"])) * F.signum(_number(b["amount"])) < 0))
    if has("admitted", "graduated"):
        years = F.datediff(_date(b["graduated"]), _date(b["admitted"])) / 365.25
        out.append(("COND-10", (b["admitted"], b["graduated"]), ~years.between(b.get("min_years", 1), b.get("max_years", 10))))
    if has("total", "parts"):
        t, s = _number(b["total"]), reduce(lambda x, y: x + y, [F.coalesce(_number(p), F.lit(0.0)) for p in b["parts"]])
        out.append(("COND-11", (b["total"], *b["parts"]), F.abs(t - s) > 0.01 * F.greatest(F.abs(t), F.lit(1.0))))
    return out


def orphans(df, key, reference, reference_key, rid="_rid"):
    """COND-04: rows whose key is missing from the reference table."""
    known = reference.select(F.col(reference_key).alias("_k")).filter("_k is not null")
    rows = df.select(F.col(rid).alias("_rid"), _c(key).alias("_k")).filter("_k is not null")
    return rows.join(known, "_k", "left_anti").select("_rid", F.col("_k").cast("string").alias("value"))


def contradictory_status(df, key, status, rid="_rid"):
    """COND-12: all rows of a key that has both an active and an inactive status."""
    s = _text(status)
    both = (df.filter(_c(key).isNotNull()).groupBy(_c(key).alias("_k")).agg(F.max(s.isin(*ACTIVE_WORDS)).alias("a"), F.max(s.isin(*INACTIVE_WORDS)).alias("i"))
            .filter("a and i").select("_k"))
    rows = df.select(F.col(rid).alias("_rid"), _c(key).alias("_k"))
    return rows.join(both, "_k", "left_semi").select("_rid", F.col("_k").cast("string").alias("value"))


def violations(df, bindings, references=None, as_of=None, rid="_rid"):
    """Long table of findings: rule, column, _rid, value. ``references``: {key column: (table, key)}."""
    checks = row_checks(bindings, as_of)
    parts = []
    if checks:
        found = F.array_compact(F.array(*[
            F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(cols[0]).alias("column"), _c(cols[0]).cast("string").alias("value")))
            for rule, cols, cond in checks]))
        parts.append(df.select(F.col(rid).alias("_rid"), F.inline(found)).select("rule", "column", "_rid", "value"))
    for key, (table, ref_key) in (references or {}).items():
        parts.append(orphans(df, key, table, ref_key, rid).select(F.lit("COND-04").alias("rule"), F.lit(key).alias("column"), "_rid", "value"))
    if "key" in bindings and "key_status" in bindings:
        parts.append(contradictory_status(df, bindings["key"], bindings["key_status"], rid).select(F.lit("COND-12").alias("rule"), F.lit(bindings["key"]).alias("column"), "_rid", "value"))
    if not parts:
        return df.sparkSession.createDataFrame([], f"rule string, column string, _rid {dict(df.dtypes)[rid]}, value string")
    return reduce(DataFrame.unionByName, parts)


def check_summary(df, bindings, as_of=None):
    """Violations per row check, all in one pass: rule, n_violations, passed."""
    checks = row_checks(bindings, as_of)
    if not checks:
        return df.sparkSession.createDataFrame([], "rule string, n_violations bigint, passed boolean")
    wide = df.agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.count_if(cond).alias("n_violations")) for r, _, cond in checks]).alias("s"))
    return wide.select(F.inline("s")).withColumn("passed", F.col("n_violations") == 0)


#: Words of dates in the order in which they follow each other (a fixed value).
DATE_SEQUENCE = (("application", "apply", "submit"), ("start", "begin"), ("interview", "review", "assess"), ("offer", "accept"), ("join", "enrol", "admit", "admission", "hire"),
                 ("complete", "graduat", "end", "finish", "discharge"))


def bind_columns(columns, types=None):
    """Column for each part of the checks, from whole name tokens (and semantic types where given)."""
    types = types or {}
    def find(*names, kind=None):
        by_type = [c for c in columns if kind and types.get(c) == kind]
        return next((c for c in columns if set(c.lower().split("_")) & set(names)), by_type[0] if by_type else None)
    b = {"status": find("status", "state", kind="STAT"), "completed_date": find("discharge", "completed", "closed", "completion"), "paid_amount": find("paid", "payment", "amount", kind="AMT"),
         "age": find("age", kind="AGE"), "birth_date": find("dob", "birth", "birthdate"), "score": find("score", "marks", kind="SCORE"), "result": find("result", "passed", "pass"),
         "title": find("title", "salutation"), "gender": find("gender", "sex", kind="GEN"), "country": find("country", kind="CNTRY"), "phone": find("phone", "mobile", kind="PHONE"),
         "quantity": find("quantity", "qty", kind="QTY"), "amount": find("amount", "total") or find("price", kind="AMT"), "admitted": find("admission", "admitted"), "graduated": find("graduation", "graduated")}
    # parts that only missing values need
    b |= {"city": find("city", kind="CITY"), "address": find("address", kind="ADDR"), "full_name": next((c for c in columns if c.lower() in ("full_name", "fullname")), None), "price": find("price", "unitprice"),
          "duration": find("duration", kind="DUR"), "start": find("start", "begin", "admission"), "end": find("end", "finish", "discharge"), "fiscal_year": find("fiscal", "fy", kind="FISC")}
    # a total is held against columns that name themselves parts, else against the other columns of its own formula set
    b["total"] = find("total", "sum", "grand")
    others = [c for c in columns if c != b["total"]]
    parts = [c for c in others if set(c.lower().split("_")) & {"male", "female", "other", "part", "component"}]
    if b["total"] and len(parts) < 2:
        kind = types.get(b["total"])
        parts = [c for c in others if kind in ("AMT", "QTY") and types.get(c) == kind and c not in (b["quantity"], b["price"])]
    b["parts"] = parts if b["total"] and len(parts) > 1 else None
    b["total"] = b["total"] if b["parts"] else None
    b["key"] = next((c for c in columns if types.get(c) == "UID"), None) or find("id")
    b["key_status"] = b["status"] if b["key"] else None
    b["name_parts"] = [c for c in columns if c.lower() in ("first_name", "middle_name", "last_name")]
    dates = [c for c in columns if types.get(c) == "DATE" and c not in (b["birth_date"], b["fiscal_year"])]
    placed = [(next((i for i, words in enumerate(DATE_SEQUENCE) if any(t.startswith(w) for t in c.lower().split("_") for w in words)), None), c) for c in columns if types.get(c) in ("DATE", "DTM")]
    chain = [c for i, c in sorted((i, c) for i, c in placed if i is not None)]
    b["dates"] = chain if len(chain) > 1 else None
    b["date"] = dates[0] if len(dates) == 1 else None
    if b["price"] == b["amount"]:
        b["price"] = None
    return {k: v for k, v in b.items() if v}
