"""Table shape: wide to long, group labels, date granularity, misplaced headers, stackable and transposed tables."""
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DATE_GRANULARITY, MONTH_SHORT
from ..functions.text import number
from ..plans import ordered

_PERIOD = re.compile(rf"^((?:{MONTH_SHORT})|january|february|march|april|june|july|august|september|october|november|december"
                     r"|q[1-4]|quarter[1-4]|(?:19|20)\d{2}|(?:fy|cy|ay)\d{2,4}|0?[1-9]|1[0-2])$", re.I)


def period_groups(columns):
    """STRUCT-01: root -> [(column, period)] for roots that occur with at least three period tokens."""
    groups = {}
    for c in columns:
        parts = c.split("_")
        for token, root in ((parts[-1], parts[:-1]), (parts[0], parts[1:])):
            if root and _PERIOD.match(token):
                groups.setdefault("_".join(root), []).append((c, token))
                break
    return {r: g for r, g in groups.items() if len(g) >= 3}


def wide_to_long(df, ids, columns, value, period="period"):
    """STRUCT-01: one row per id and period; the period is the token of the column name."""
    found = [p for g in period_groups(columns).values() for p in g]
    tokens = dict(found)
    long = df.unpivot(list(ids), list(columns), period, value)
    named = F.create_map(*[F.lit(x) for c in columns for x in (c, tokens.get(c, c))])
    return long.withColumn(period, F.try_element_at(named, F.col(period)))


def label_columns(df, order_cols, facts=None):
    """STRUCT-02: text columns that look like group labels written once per block; numbers written as text are no labels."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in order_cols]
    if not texts:
        return []
    key = F.struct(*[F.col(f"`{c}`") for c in order_cols])
    row = df.agg(F.count(F.lit(1)), *[x for c in texts for x in (
        F.count(f"`{c}`"), F.approx_count_distinct(f"`{c}`", 0.01), F.min_by(F.col(f"`{c}`").isNotNull(), key),
        F.count(number(F.trim(F.col(f"`{c}`")))))]).first()
    chosen = []
    for k, c in enumerate(texts):
        filled, distinct, first_filled, numbers = row[4 * k + 1:4 * k + 5]
        if 0 < filled < row[0] and first_filled and numbers <= 0.2 * filled and 2 <= distinct <= max(10, 0.2 * filled):
            chosen.append(c)
    return chosen


def fill_labels(df, order_cols):
    """STRUCT-02: the label of a block is written on all its rows."""
    chosen = label_columns(df, order_cols)
    return (ordered.forward_fill(df, order_cols, chosen), chosen) if chosen else (df, [])


def granularity(v):
    t = F.trim(v)
    return reduce(lambda acc, g: acc.when(t.rlike(g[1]), F.lit(g[0])), DATE_GRANULARITY[1:], F.when(t.rlike(DATE_GRANULARITY[0][1]), F.lit(DATE_GRANULARITY[0][0])))


def granularity_report(df, columns):
    """STRUCT-03: column, granularity, n, share of the date-like values. All values are read, not a sample."""
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "cell")
    counts = (long.filter("cell is not null").select("column", granularity(F.col("cell")).alias("granularity"))
              .groupBy("column", "granularity").agg(F.count("*").alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("granularity").isNotNull(), F.col("n"))).alias("dated"))
    return (counts.filter("granularity is not null").join(totals, "column").filter(F.col("dated") >= 0.3 * F.col("all"))
            .select("column", "granularity", "n", F.round(F.col("n") / F.col("dated"), 4).alias("share")))


def mixed_granularity(report):
    """STRUCT-03: columns where two or more granularities each make up over 10 %."""
    return report.filter("share > 0.1").groupBy("column").agg(F.count("*").alias("n_granularities")).filter("n_granularities >= 2")


def _plain_number(s):
    return re.sub(r"[ _.\-]", "", s).isnumeric()


def header_offset(df, order_cols, rid="_rid", probe=10):
    """STRUCT-04: (number of rows above the real header, its names) or None. Looks at the first ten rows only."""
    cols = [c for c in df.columns if c != rid and c not in order_cols]
    ugly = sum(c.startswith("Unnamed") or re.sub(r"[.\-]", "", c).isnumeric() or re.match(r"^_c\d+$|^col_\d+$", c) is not None for c in cols) / len(cols)
    if ugly <= 0.3:
        return None
    for i, row in enumerate(df.orderBy(*order_cols).limit(probe).select(*[f"`{c}`" for c in cols]).collect()):
        cells = [str(v).strip() for v in row if v is not None and str(v).strip()]
        good = [v for v in cells if not _plain_number(v) and not v[0].isdigit() and len(v) <= 60]
        if len(cells) >= 0.6 * len(cols) and len(good) >= 0.75 * len(cells):
            return i, [str(v).strip() if v is not None else f"col_{k}" for k, v in enumerate(row)]
    return None


def promote_header(df, order_cols, rid="_rid"):
    """STRUCT-04: the found row becomes the header; it and the rows above it go."""
    from .whole_table import unique_names
    found = header_offset(df, order_cols, rid)
    if not found:
        return df
    above, names = found
    bound = df.orderBy(*order_cols).limit(above + 1).agg(F.max(F.struct(*order_cols)).alias("k")).select("k")
    fixed = [c for c in df.columns if c == rid or c in order_cols]
    kept = df.filter(F.struct(*order_cols) > bound.scalar())
    cols = [c for c in df.columns if c not in fixed]
    return kept.select(*fixed, *[F.col(f"`{c}`").alias(n) for c, n in zip(cols, unique_names(names))])


def stackable(tables, least=0.8):
    """STRUCT-05: names of the tables whose column names overlap (Jaccard) with the first by at least 0.8."""
    first = set(next(iter(tables.values())).columns)
    return [n for n, t in tables.items() if len(first & set(t.columns)) / len(first | set(t.columns)) >= least]


def stack_tables(tables, source="source_sheet"):
    """STRUCT-05: one table with a column that names the origin."""
    parts = [tables[n].withColumn(source, F.lit(n)) for n in stackable(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def looks_transposed(df, rid="_rid"):
    """STRUCT-06: number of signals (0 to 3) that rows and columns are swapped; two or more call for a question."""
    cols = [c for c in df.columns if c != rid]
    few = df.limit(20).count()
    signals = int(len(cols) > 5 * few and few < 20)
    v = F.col(f"`{cols[0]}`").cast("string")
    row = df.agg(F.count(v), F.approx_count_distinct(v, 0.01), F.max(F.length(v)), F.count_if(v.rlike("^[a-zA-Z][a-zA-Z0-9_]*$"))).first()
    is_text = dict(df.dtypes)[cols[0]] == "string"
    signals += int(is_text and row[0] >= 2 and row[1] >= row[0] * 0.98 and row[2] <= 60 and row[3] >= 0.5 * row[0])
    dataish = sum(bool(re.match(r"^[\d.,\-]+$|^\d{4}[-/]\d{2}([-/]\d{2})?$|^(row|item|record|entry)[\s_]?\d+$", c, re.I)) for c in cols)
    return signals + int(dataish > 0.5 * len(cols))


def transpose_table(df, name_column, columns):
    """STRUCT-06: the values of ``name_column`` become the columns. Only for tables that are narrow once turned."""
    long = df.select(name_column, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([name_column], list(columns), "record", "value")
    return long.groupBy("record").pivot(name_column).agg(F.first("value"))
