"""Order-sensitive operators over a whole table: running totals, moving averages, fills, neighbours, ranks.

A window without ``partitionBy`` runs in one task. Here the table is cut into ranges of the order key, the window runs
inside each range, and what crosses a boundary (a total, a last value) is carried over by a scan over a tree: ranges are
gathered BRANCH to a node, a node's sum or last value is scanned first, then those of its ranges. The number of ranges follows the
rows without a cap. The cut points are sampled once by a hash, so a recomputed task sees the same ranges; where the
sample is large, it is itself put in order by ranges, and only every n-th of its keys reaches the driver. Up to LITERALS cut
points stand in the plan as a tree of comparisons, more are looked up in a table of one row.
Order keys include the row id: a timestamp shared by a third of the rows is still split.
"""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .facts import attach

SAMPLE_PER_RANGE = 40
ROWS_PER_RANGE = 200_000
#: Cut points that are written into the plan; keys of a sample that the driver orders; ranges of a node of the tree.
LITERALS, DRIVER_KEYS, BRANCH = 1024, 200_000, 1024


def cut_points(df, keys, ranges=None, seed=7):
    """Boundaries of ``keys`` (a list of column names) that cut the rows into ``ranges`` parts, from a sample.

    Without ``ranges`` the number follows the row count. A hash of the key decides who is sampled, so a repeated run
    picks the same rows. What reaches the driver is one key per range, or a sample of at most four times DRIVER_KEYS.
    """
    total = df.count()
    ranges = ranges or max(1, total // ROWS_PER_RANGE)
    if ranges <= 1 or total < ranges * 2:
        return []
    wanted = ranges * SAMPLE_PER_RANGE
    cols = [F.col(f"`{k}`") for k in keys]
    draw = F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1_000_000_000)) < int(min(1.0, wanted / total) * 1_000_000_000) + 1
    sample = df.filter(draw).select(*cols)
    if wanted <= DRIVER_KEYS:
        rows = sorted_keys(sample.orderBy(F.xxhash64(*cols, F.lit(seed + 1))).limit(4 * wanted).collect())
        step = len(rows) / ranges
        return list(dict.fromkeys(rows[int(i * step)] for i in range(1, ranges))) if len(rows) >= ranges else rows
    placed = numbered(sample.distinct(), keys, "_place")
    step = max(1, placed.count() // ranges)
    return sorted_keys(placed.filter((F.col("_place") > 0) & (F.col("_place") % step == 0)).select(*cols).collect())


def sorted_keys(rows):
    """Different keys in order, nulls first, as Spark orders them."""
    return sorted({tuple(r) for r in rows}, key=lambda t: [(v is not None, v) for v in t])


def range_of(keys, cuts, types):
    """Index of the range a row falls in: a balanced tree of comparisons, log2(ranges) per row. Nulls sort first."""
    key = F.struct(*[F.col(f"`{k}`") for k in keys])

    def tree(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, cuts[mid])])
        return F.when(key < bound, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def range_from_table(df, keys, cuts, types):
    """The table with `_range` from a table of one row: first among every root-th cut point, then among those between."""
    step = max(1, int(len(cuts) ** 0.5))
    kind = "struct<" + ",".join(f"k{i}:{types[k]}" for i, k in enumerate(keys)) + ">"
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    table = df.sparkSession.createDataFrame([([g[0] for g in groups], groups)], f"_heads array<{kind}>, _groups array<array<{kind}>>")
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])
    upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
    group = upto(F.col("_heads"))
    inner = upto(F.element_at("_groups", F.greatest(group, F.lit(1))))
    return attach(df, table).withColumn("_range", F.when(group == 0, 0).otherwise((group - 1) * step + inner)).drop("_heads", "_groups")


def with_ranges(df, keys, ranges=None):
    cuts, types = cut_points(df, keys, ranges), dict(df.dtypes)
    return df.withColumn("_range", range_of(keys, cuts, types)) if len(cuts) <= LITERALS else range_from_table(df, keys, cuts, types)


def carried_over(per_range, sums=(), lasts=(), firsts=()):
    """For each range (one row each): the sum of ``sums`` and the last non-null of ``lasts`` over the ranges before, and the first non-null of ``firsts`` over those behind.

    A scan over two levels of a tree: nodes of BRANCH ranges, then the ranges of a node. A node's window sees one row per node.
    """
    node = per_range.withColumn("_node", F.floor(F.col("_range") / BRANCH).cast("int"))
    key = F.col("_range")
    above = node.groupBy("_node").agg(F.count(F.lit(1)).alias("_ranges"), *[F.sum(f"`{c}`").alias(f"{c}~") for c in sums],
                                      *[F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), key)).alias(f"{c}~") for c in lasts],
                                      *[F.min_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), key)).alias(f"{c}~") for c in firsts])

    def scanned(frame, order, inside, end):
        before = W.partitionBy(*inside).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        after = W.partitionBy(*inside).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
        return frame.select("*", *[F.sum(f"`{c}{end}`").over(before).alias(f"{c}{end}<") for c in sums], *[F.last(f"`{c}{end}`", ignorenulls=True).over(before).alias(f"{c}{end}<") for c in lasts],
                            *[F.last(f"`{c}{end}`", ignorenulls=True).over(after).alias(f"{c}{end}<") for c in firsts])

    joined = scanned(node, "_range", ["_node"], "").join(scanned(above, "_node", [], "~"), "_node")
    return joined.select("_range", *[(F.coalesce(f"`{c}~<`", F.lit(0)) + F.coalesce(f"`{c}<`", F.lit(0))).alias(c) for c in sums],
                         *[F.coalesce(f"`{c}<`", f"`{c}~<`").alias(c) for c in (*lasts, *firsts)])


def _order(keys):
    return [F.col(f"`{k}`") for k in keys]


def running_totals(df, keys, totals, ranges=None):
    """Sums over all rows up to this one in key order, several in one pass: ``totals`` is {new column: column}; null counts as 0."""
    value = {out: F.coalesce(F.col(f"`{v}`"), F.lit(0)) for out, v in totals.items()}
    cut = with_ranges(df, keys, ranges)
    per_range = cut.groupBy("_range").agg(*[F.sum(v).alias(f"{out}~carry") for out, v in value.items()])
    carried = carried_over(per_range, sums=[f"{out}~carry" for out in totals])
    inner = W.partitionBy("_range").orderBy(*_order(keys)).rowsBetween(W.unboundedPreceding, 0)
    within = cut.select("*", *[F.sum(v).over(inner).alias(f"{out}~within") for out, v in value.items()])
    return within.join(carried, "_range").select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"`{out}~within`") + F.col(f"`{out}~carry`")).alias(out) for out in totals])


def running_total(df, keys, value, out, ranges=None):
    return running_totals(df, keys, {out: value}, ranges)


def numbered(df, keys, out="_pos", ranges=None):
    """Global 0-based position in key order."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_total(one, keys, "_one", out, ranges).withColumn(out, F.col(out) - 1).drop("_one")


def moving_average(df, keys, value, n, out, block=100_000, ranges=None):
    """Mean of the last ``n`` rows; null for the first ``n - 1``.

    Rows are numbered, cut into blocks, and the last ``n - 1`` rows of a block are also given to the next one.
    """
    block = max(block, n)
    placed = numbered(df, keys, "_pos", ranges).withColumn("_block", F.expr(f"_pos div {block}"))
    spill = F.expr(f"_pos % {block} >= {block - (n - 1)}")
    copies = placed.withColumn("_home", F.explode(
        F.when(spill, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))))
    w = W.partitionBy("_home").orderBy("_pos").rowsBetween(-(n - 1), 0)
    return (copies.withColumn(out, F.when(F.col("_pos") >= n - 1, F.avg(f"`{value}`").over(w)))
            .filter(F.col("_home") == F.col("_block")).drop("_home", "_block", "_pos"))


def neighbours(df, keys, columns, ranges=None, following=True, inclusive=False):
    """Nearest earlier (and later) non-null value of each column, in key order.

    Adds ``<c>_prev`` and, with ``following``, ``<c>_next``. ``inclusive`` lets a row see its own value (forward fill).
    """
    cut = with_ranges(df, keys, ranges)
    key = F.struct(*_order(keys))
    edge = 0 if inclusive else -1
    back = W.partitionBy("_range").orderBy(*_order(keys)).rowsBetween(W.unboundedPreceding, edge)
    # looking ahead is looking back in reverse order: a frame that grows costs one step per row, one that shrinks is
    # recomputed for every row
    ahead = W.partitionBy("_range").orderBy(*[k.desc() for k in _order(keys)]).rowsBetween(W.unboundedPreceding, edge)
    seen = lambda c: F.col(f"`{c}`").isNotNull()
    ends = cut.groupBy("_range").agg(
        *[F.max_by(F.col(f"`{c}`"), F.when(seen(c), key)).alias(f"{c}~last") for c in columns],
        *([F.min_by(F.col(f"`{c}`"), F.when(seen(c), key)).alias(f"{c}~first") for c in columns] if following else []))
    carried = carried_over(ends, lasts=[f"{c}~last" for c in columns], firsts=[f"{c}~first" for c in columns] if following else [])
    inner = cut.select(
        "*", *[F.last(F.col(f"`{c}`"), ignorenulls=True).over(back).alias(f"{c}~b") for c in columns],
        *([F.last(F.col(f"`{c}`"), ignorenulls=True).over(ahead).alias(f"{c}~a") for c in columns] if following else []))
    joined = inner.join(carried, "_range")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.coalesce(F.col(f"`{c}~b`"), F.col(f"`{c}~last`")).alias(f"{c}_prev") for c in columns],
        *([F.coalesce(F.col(f"`{c}~a`"), F.col(f"`{c}~first`")).alias(f"{c}_next") for c in columns] if following else []))


def forward_fill(df, keys, columns, ranges=None):
    filled = neighbours(df, keys, columns, ranges, following=False, inclusive=True)
    return filled.select(*[F.col(f"`{c}_prev`").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def forward_fill_audited(df, keys, columns, rule, rid="_rid", ranges=None):
    """The table of ``forward_fill``, and one line per filled cell: rule, column, _rid, old_value (null), new_value."""
    paired = neighbours(df, keys, columns, ranges, following=False, inclusive=True)
    filled = paired.select(*[F.col(f"`{c}_prev`").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
    lines = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull() & F.col(f"`{c}_prev`").isNotNull(), F.struct(
        F.lit(c).alias("column"), F.lit(None).cast("string").alias("old_value"), F.col(f"`{c}_prev`").cast("string").alias("new_value"))) for c in columns]))
    return filled, paired.select(F.lit(rule).alias("rule"), F.col(f"`{rid}`").alias("_rid"), F.inline(lines))


def rank_within(df, group, value, out="rank", ascending=False, ranges=None):
    """SQL rank() of every row inside its group.

    Rows are first counted per (group, value); those counts are ranged by (group, value), so a group with a third of
    all rows is spread over many ranges, and each range adds what the earlier ranges of the same group hold.
    """
    nulls_apart = df.filter(F.col(f"`{value}`").isNotNull())
    sign = 1 if ascending else -1
    counts = (nulls_apart.groupBy(F.col(f"`{group}`").alias("_g"), F.col(f"`{value}`").alias("_v"))
              .agg(F.count("*").alias("_n")).withColumn("_k", F.col("_v") * sign))
    cut = with_ranges(counts, ["_g", "_k"], ranges)
    carried = (cut.groupBy("_g", "_range").agg(F.sum("_n").alias("_t"))
               .withColumn("_carry", F.sum("_t").over(
                   W.partitionBy("_g").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))).drop("_t"))
    inner = W.partitionBy("_range", "_g").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    ranked = (cut.withColumn("_s", F.sum("_n").over(inner)).join(carried, ["_g", "_range"])
              .select("_g", "_v", (F.coalesce("_s", F.lit(0)) + F.coalesce("_carry", F.lit(0)) + 1).alias(out)))
    return df.join(ranked, (F.col(f"`{group}`") == F.col("_g")) & (F.col(f"`{value}`") == F.col("_v")), "left").drop("_g", "_v")


def integer_gaps(df, column, start=None, ranges=None):
    """Missing integers between neighbours of ``column``, as (gap_start, gap_end); never the full range."""
    present = df.select(F.col(f"`{column}`").cast("long").alias("k")).filter("k is not null").distinct()
    if start is not None:
        present = present.filter(F.col("k") >= start)
    seen = present.withColumn("here", F.col("k"))
    paired = neighbours(seen, ["k"], ["here"], ranges, following=False)
    previous = F.col("here_prev") if start is None else F.coalesce("here_prev", F.lit(start - 1))
    return (paired.select((previous + 1).alias("gap_start"), (F.col("k") - 1).alias("gap_end"))
            .filter("gap_end >= gap_start"))
