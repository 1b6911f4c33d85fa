"""The whole way from raw text to a clean, typed, checked table with its findings and audit.

Steps that need statistics run one aggregate each; everything between two of them is one lazy plan. With ``workdir`` the
table is written between the big stages, so that later passes read the result instead of repeating it, and a lost
executor costs one stage at most. A step that cannot be planned is skipped, reported, and leaves the table as it was.

What other columns determine is filled before anything is guessed: labels and merged cells, written on the rows below, come after it, means and most
frequent values last. Every filled cell has a line in the audit.
"""
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType

from ..operators import basic, categorical, contact, duplicates, identity, medical, missing, numeric, organisation, structure, temporal, text_columns, validation, whole_table
from ..operators.rules import apply_rules
from ..sources.reader import spread
from . import ordered, profile


def rules_for(kind, column, types, as_of, country="US"):
    """Rules of one column by formula set. ``types`` lets a rule find its partner column; sets without rules give None."""
    partner = lambda k: next((c for c, s in types.items() if s == k), None)
    return {
        "FNAME": lambda: identity.full_name_rules(column), "SNAME": lambda: identity.short_name_rules(column), "UID": lambda: identity.uid_rules(column),
        "AGE": lambda: identity.age_rules(column), "GEN": lambda: identity.gender_rules(column),
        "DATE": lambda: temporal.date_rules(column, as_of), "TIME": lambda: temporal.time_rules(column), "DTM": lambda: temporal.datetime_rules(column, as_of, partner("UID")),
        "DUR": lambda: temporal.duration_rules(column), "FISC": lambda: temporal.fiscal_rules(column),
        "PHONE": lambda: contact.phone_rules(column, country, partner("UID")), "EMAIL": lambda: contact.email_rules(column), "ADDR": lambda: contact.address_rules(column),
        "CITY": lambda: contact.city_rules(column, partner("ADDR")), "CNTRY": lambda: contact.country_rules(column), "POST": lambda: contact.postal_rules(column, partner("CNTRY")),
        "GEO": lambda: contact.coordinate_rules(column),
        "AMT": lambda: numeric.amount_rules(column), "QTY": lambda: numeric.quantity_rules(column), "PCT": lambda: numeric.percentage_rules(column),
        "SCORE": lambda: numeric.score_rules(column), "CUR": lambda: numeric.currency_rules(column), "RANK": lambda: numeric.rank_rules(column),
        "BOOL": lambda: categorical.boolean_rules(column), "CAT": lambda: categorical.category_rules(column), "STAT": lambda: categorical.status_rules(column),
        "SURV": lambda: categorical.survey_rules(column), "MULTI": lambda: categorical.multi_value_rules(column),
        "PROD": lambda: organisation.product_rules(column, partner("SKU")), "SKU": lambda: organisation.sku_rules(column, partner("PROD")), "ORG": lambda: organisation.org_rules(column),
        "JOB": lambda: organisation.job_rules(column, partner("DEPT")), "DEPT": lambda: organisation.department_rules(column), "REFNO": lambda: organisation.reference_rules(column),
        "VER": lambda: organisation.version_rules(column),
        "TEXT": lambda: text_columns.text_rules(column), "URL": lambda: text_columns.url_rules(column), "IP": lambda: text_columns.ip_rules(column), "FILE": lambda: text_columns.path_rules(column),
        "DIAG": lambda: medical.diagnosis_rules(column), "PHYS": lambda: medical.measurement_rules(column),
    }.get(kind, lambda: None)()


FLAG_COLUMNS = ("rule", "column", "_rid", "value")
AUDIT_COLUMNS = ("rule", "column", "_rid", "old_value", "new_value")


@dataclass
class CleanTable:
    table: DataFrame
    flags: DataFrame
    audit: DataFrame
    types: DataFrame
    quality: DataFrame
    skipped: list = field(default_factory=list)


def as_text(column, kind):
    """A cell as a person would write it: numbers without an exponent where they have at most ten decimals."""
    v = F.col(f"`{column}`")
    if isinstance(kind, (DoubleType, FloatType)):
        plain = F.regexp_replace(v.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
        usual = (F.abs(v) >= 1e-6) & (v.cast("decimal(38,10)").cast("double") == v.cast("double"))
        return F.when(v == 0, "0").when(usual, plain).otherwise(v.cast("string"))
    return v.cast("string")


def _shaped(df, columns):
    have = set(df.columns)
    return df.select(*[(F.col("_rid").cast("long") if c == "_rid" else F.col(c).cast("string")).alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def clean_table(df, as_of, confirmed_columns=None, external_types=None, bindings=None, references=None, order_cols=("_rid",), country="US", workdir=None, rid="_rid"):
    """Raw text table with a row id -> ``CleanTable``. ``external_types`` is merged with the detected types."""
    skipped, flags, audits = [], [], []

    def keep(frame, name):
        if not workdir:
            return frame
        frame.write.mode("overwrite").parquet(f"{workdir}/{name}")
        return frame.sparkSession.read.parquet(f"{workdir}/{name}")

    def attempt(name, step, fallback):
        try:
            return step()
        except AnalysisException as e:
            skipped.append((name, str(e).splitlines()[0]))
            return fallback

    if workdir:
        # Every later pass reads these files: in as many parts as there are cores, and what the input is derived from is worked out once.
        df = keep(spread(df, rid), "raw")
    table, found, changed = attempt("whole table", lambda: whole_table.clean_global(df, order_cols, rid, fill=False), (df, None, None))
    if found is not None:
        flags.append(_shaped(found, FLAG_COLUMNS))
        audits.append(_shaped(changed, AUDIT_COLUMNS))
    original_rows = df.count()
    if confirmed_columns:
        table = table.select(*[c for c in table.columns if c == rid or c in confirmed_columns])
    table = keep(table, "shaped")

    types = profile.semantic_types(table, rid=rid)
    if external_types is not None:
        merged = profile.merge_types(types, external_types)
        flags.append(_shaped(merged.filter("decision in ('conflict', 'low_confidence')").select(F.concat(F.lit("HTYPE-MERGE "), "decision").alias("rule"), "column"), FLAG_COLUMNS))
        chosen = {r["column"]: r["formula_set"] for r in merged.collect()}
    else:
        chosen = profile.type_map(types)
    # Formula sets are rules over text; columns of other types go through them as text and come back to their type.
    typed = {f.name: f.dataType for f in table.schema.fields if f.name != rid and isinstance(f.dataType, (NumericType, DateType, TimestampType, TimestampNTZType, BooleanType))}
    rules = [r for r in (attempt(f"rules of {c}", lambda c=c, k=k: rules_for(k, c, chosen, as_of, country), None) for c, k in chosen.items() if c in table.columns) if r]
    ruled = {r.column for r in rules} & set(typed)
    texts = table.select(*[as_text(c, typed[c]).alias(c) if c in ruled else F.col(f"`{c}`") for c in table.columns])
    cleaned = attempt("typed rules", lambda: apply_rules(texts, rules, rid), None)
    if cleaned is not None:
        cleaned = cleaned.saved(f"{workdir}/typed") if workdir else cleaned
        kinds = dict(cleaned.table.dtypes)
        table = cleaned.table.select(*[F.col(f"`{c}`").try_cast(typed[c]).alias(c) if c in ruled and kinds[c] == "string" else F.col(f"`{c}`") for c in cleaned.table.columns])
        flags.append(_shaped(cleaned.flags, FLAG_COLUMNS))
        audits.append(_shaped(cleaned.audit.withColumnRenamed(rid, "_rid"), AUDIT_COLUMNS))

    bindings = bindings if bindings is not None else validation.bind_columns(table.columns, chosen)
    table, fills = attempt("missing values", lambda: missing.resolve_missing_audited(table, bindings, as_of, rid=rid), (table, None))
    if fills is not None:
        audits.append(_shaped(fills, AUDIT_COLUMNS))
    order = [c for c in order_cols if c in table.columns] or [rid]
    for name, rule, columns_of in (("group labels", "STRUCT-02", lambda t: structure.label_columns(t, order)), ("merged cells", "GLOBAL-13", lambda t: whole_table.merged_cell_columns(t, order, rid))):
        columns = attempt(name, lambda: [c for c in columns_of(table) if c != rid], [])
        if columns:
            table, lines = attempt(name, lambda: ordered.forward_fill_audited(table, order, columns, rule, rid), (table, None))
            if lines is not None:
                audits.append(_shaped(lines, AUDIT_COLUMNS))
    table = keep(table, "filled")
    table = attempt("exact duplicates", lambda: duplicates.drop_exact(table, rid), table)
    table = keep(table, "unique")
    checked = attempt("cross-column checks", lambda: validation.violations(table, bindings, references, as_of, rid), None)
    if checked is not None:
        flags.append(_shaped(checked, FLAG_COLUMNS))
    if bindings.get("key") in table.columns:
        key = bindings["key"]
        alike = attempt("partial duplicates", lambda: duplicates.partial_groups(table, [key], rid), None)
        if alike is not None:
            flags.append(_shaped(alike.select(F.lit("DUP-PARTIAL").alias("rule"), F.lit(key).alias("column"), F.col("first_rid").alias("_rid"), F.array_join(F.array_distinct(F.concat("conflicts", "gaps")), ",").alias("value")), FLAG_COLUMNS))
        moments = [c for c, t in table.dtypes if t.startswith(("date", "timestamp")) and c != bindings.get("birth_date")]
        if moments:
            often = attempt("temporal duplicates", lambda: duplicates.temporal_groups(table, [key], moments, rid), None)
            if often is not None:
                flags.append(_shaped(often.select(F.lit("DUP-TEMPORAL").alias("rule"), F.lit(key).alias("column"), F.lit(None).cast("long").alias("_rid"), F.col(f"key_{key}").alias("value")), FLAG_COLUMNS))
    if "address" in bindings and "city" in bindings:
        hints = attempt("city from address", lambda: missing.city_from_address(table, bindings["address"], bindings["city"]), None)
        if hints is not None:
            hint = F.col(f"`{bindings['city']}_suggestion`")
            flags.append(_shaped(hints.filter(hint.isNotNull()).select(F.lit("MV-CITY").alias("rule"), F.lit(bindings["city"]).alias("column"), F.col(rid).alias("_rid"), hint.alias("value")), FLAG_COLUMNS))
    final, fills = attempt("basic pass", lambda: basic.basic_clean_audited(table, rid), (table, None))
    final = keep(final, "clean")
    if fills is not None:
        audits.append(_shaped(fills, AUDIT_COLUMNS))
    empty = lambda cols: df.sparkSession.createDataFrame([], ", ".join(f"`{c}` {'bigint' if c == '_rid' else 'string'}" for c in cols))
    union = lambda parts, cols: reduce(DataFrame.unionByName, parts) if parts else empty(cols)
    return CleanTable(final, union(flags, FLAG_COLUMNS), union(audits, AUDIT_COLUMNS), types, basic.quality_score(final, original_rows, rid), skipped)
