"""Writing results, the audit store, and the decisions a person makes on them."""
import uuid
from urllib.parse import unquote

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def export_csv(df, path, rid="_rid"):
    """SNK-01: delimited text with a header, without the row id; one file per partition."""
    df.drop(rid).write.mode("overwrite").option("header", True).csv(path)


def append_audit(audit, path, job_id, written_at, auto=True, rid="_rid"):
    """SNK-02: one line per change, partitioned by rule. ``written_at`` is a timestamp literal, the same for the whole job."""
    lines = audit.select(F.lit(job_id).alias("job_id"), F.col(rid).cast("long").alias("row_index"), F.col("column").alias("column_name"), F.col("rule").alias("formula_id"),
                         F.col("old_value").alias("original_value"), "new_value", F.lit(auto).alias("was_auto_applied"), F.lit(written_at).cast("timestamp_ntz").alias("timestamp"))
    lines.write.mode("append").partitionBy("formula_id").parquet(path)


PAGE_KEY = ("timestamp", "row_index", "column_name", "formula_id")


def _page_key():
    return F.struct(*[F.coalesce(F.col(c), F.lit(-1)) if c == "row_index" else F.coalesce(F.col(c), F.lit("")) if c != "timestamp" else F.col(c) for c in PAGE_KEY])


def append_paged_audit(audit, path, job_id, written_at, auto=True, rid="_rid"):
    """SNK-02 for reading page by page: lines in key order, each file a range of keys, and beside them a manifest with the least and greatest key and the number of lines of each file.

    Nothing that was written is touched: an append adds files and manifest rows. A job that fails between the two leaves lines that no manifest names and no page shows.
    """
    lines = audit.select(F.lit(job_id).alias("job_id"), F.col(rid).cast("long").alias("row_index"), F.col("column").alias("column_name"), F.col("rule").alias("formula_id"),
                         F.col("old_value").alias("original_value"), "new_value", F.lit(auto).alias("was_auto_applied"), F.lit(written_at).cast("timestamp_ntz").alias("timestamp"))
    batch = f"{path}/lines/{uuid.uuid4().hex}"
    lines.repartitionByRange(*[F.col(c) for c in PAGE_KEY]).sortWithinPartitions(*PAGE_KEY).write.parquet(batch)
    written = lines.sparkSession.read.schema(lines.schema).parquet(batch)
    key = _page_key()
    files = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n"))
    files.coalesce(1).write.mode("append").parquet(f"{path}/manifest")      # one row per file


def page_files(manifest, page, size):
    """Files that hold lines page * size to (page + 1) * size of the whole order, and how many of their lines come before the page. ``manifest``: (file, low, high, n)."""
    ordered, chosen, before, start, end = sorted(manifest, key=lambda f: (f[1], f[2])), [], 0, page * size, (page + 1) * size
    at = 0
    while at < len(ordered):
        # Files whose ranges overlap stand for one stretch of the order.
        group, high = [ordered[at]], ordered[at][2]
        while at + len(group) < len(ordered) and ordered[at + len(group)][1] <= high:
            group.append(ordered[at + len(group)])
            high = max(high, group[-1][2])
        n = sum(f[3] for f in group)
        if before + n > start and before < end:
            skipped = before if not chosen else skipped
            chosen += [f[0] for f in group]
        before += n
        at += len(group)
    return chosen, start - skipped if chosen else 0


def audit_page_of(spark, path, page, size=100):
    """SNK-03: page ``page`` (from 0) of a paged audit, oldest first: reads the manifest and the one or two files that hold it."""
    rows = spark.read.parquet(f"{path}/manifest").collect()
    files, skip = page_files([(r["file"], tuple(r["low"]), tuple(r["high"]), r["n"]) for r in rows], page, size)
    lines = spark.read.parquet(*(unquote(f) for f in files)) if files else spark.read.option("recursiveFileLookup", True).parquet(f"{path}/lines").limit(0)
    return lines.orderBy(_page_key()).offset(skip).limit(size)


def flag_lines(flags, job_id, written_at, action="flag"):
    """SNK-02 for findings: nothing was changed."""
    return flags.select(F.lit(job_id).alias("job_id"), F.col("_rid").alias("row_index"), F.col("column").alias("column_name"), F.col("rule").alias("formula_id"), F.lit(action).alias("action"),
                        F.col("value").alias("original_value"), F.lit(False).alias("was_auto_applied"), F.lit(written_at).cast("timestamp_ntz").alias("timestamp"))


def audit_page(audit, limit=100, offset=0):
    """SNK-03: one page of the audit, oldest first. ``limit`` is the page size."""
    return audit.orderBy("timestamp", "row_index", "column_name", "formula_id").offset(offset).limit(limit)


def outlier_lines(lines):
    """SNK-04."""
    return lines.filter(F.col("action") == "flag_outlier")


def missing_report(df, rid="_rid"):
    """SNK-05: column, null count and share, type, and how to fill it."""
    kind = lambda t: "median" if isinstance(t, NumericType) else "forward_fill" if isinstance(t, (DateType, TimestampType, TimestampNTZType)) else "mode"
    fields = [f for f in df.schema.fields if f.name != rid]
    wide = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(
        F.lit(f.name).alias("column"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("null_count"), F.lit(kind(f.dataType)).alias("suggested_fill")) for f in fields]).alias("s"))
    return wide.select("n", F.inline("s")).filter("null_count > 0").select("column", "null_count", F.round(F.col("null_count") / F.col("n") * 100, 2).alias("null_pct"), "suggested_fill")


def apply_patches(df, patches, rid="_rid"):
    """SNK-06: (table, audit) after (_rid, column, value) patches, themselves a table."""
    names = [r[0] for r in patches.select("column").distinct().collect()]
    cols = [c for c in df.columns if c in names]
    wide = patches.filter(F.col("column").isin(*cols)).groupBy(F.col("_rid").alias("_p")).pivot("column", cols).agg(F.max("value"))
    wide = wide.toDF("_p", *[f"~{c}" for c in cols])
    joined = df.join(wide, F.col(rid) == F.col("_p"), "left")
    types = dict(df.dtypes)
    new = lambda c: F.coalesce(F.col(f"`~{c}`").try_cast(types[c]), F.col(f"`{c}`"))
    table = joined.select(*[new(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])
    changed = F.array_compact(F.array(*[F.when(F.col(f"`~{c}`").isNotNull(), F.struct(
        F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("old_value"), F.col(f"`~{c}`").alias("new_value"))) for c in cols]))
    return table, joined.filter("_p is not null").select(F.col(rid).alias("_rid"), F.inline(changed))


def resolve_outliers(df, decisions, rid="_rid"):
    """SNK-07: rows decided 'remove' go; ``decisions`` is (_rid, decision)."""
    gone = decisions.filter(F.col("decision") == "remove").select(F.col("_rid").alias(rid))
    return df.join(gone, rid, "left_anti")


def drop_columns(df, columns):
    """SNK-08: (table, names that were not there)."""
    return df.drop(*[c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def confirmed_columns(df, columns, rid="_rid"):
    """SNK-09: only the confirmed columns, in table order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c == rid or c in set(columns)])
