"""Exact quantiles by radix selection: four counting scans, however many rows, columns and probabilities there are.

A double's bits, with those of negative numbers turned over, order like the double. Each scan counts the rows by the next DIGIT bits among those that
share the bits found so far with a wanted rank, for all columns at once; counting combines before the shuffle, and a value that a third of the rows
have is one count. Which digit holds a rank follows from running sums over at most 2^DIGIT counts, so what reaches the driver is one row per
column and rank. Nothing depends on the number of rows.
"""
import math
import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

DIGIT, BITS = 16, 64


def ordered_bits(df, values):
    """One row per value that is a number: column (its place in ``values``), key: the double's bits as a long of the same order; 0.0 and -0.0 are one.

    Exponent and fraction are worked out by arithmetic that is exact: powers of two, and products and quotients with them.
    """
    n, power = range(len(values)), lambda e: F.pow(F.lit(2.0), e)
    raw = df.select(*[F.when(~F.isnan(v), v).alias(f"v{i}") for i, v in enumerate(x.cast("double") for x in values)])
    near = raw.select(*[f"v{i}" for i in n], *[F.least(F.greatest(F.floor(F.log2(F.abs(f"v{i}"))), F.lit(-1022)), F.lit(1023)).alias(f"e{i}") for i in n])
    # The logarithm may be off by one beside a power of two.
    part = lambda i: F.abs(f"v{i}") / power(F.col(f"e{i}"))
    exact = near.select(*[f"v{i}" for i in n], *[(F.col(f"e{i}") + F.when((part(i) >= 2) & (F.col(f"e{i}") < 1023), 1).when((part(i) < 1) & (F.col(f"e{i}") > -1022), -1).otherwise(0)).alias(f"e{i}") for i in n])

    def bits(i):
        a, fraction = F.abs(f"v{i}"), part(i)
        tiny = (a * power(F.lit(1000.0)) * power(F.lit(74.0))).cast("long")
        usual = (F.col(f"e{i}") + 1023) * F.lit(1 << 52) + ((fraction - 1) * F.lit(float(1 << 52))).cast("long")
        return F.when(a == float("inf"), F.lit(2047 << 52)).when(a < 2.0 ** -1022, tiny).otherwise(usual)

    keyed = exact.select(*[f"v{i}" for i in n], *[bits(i).alias(f"b{i}") for i in n])
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.when(F.col(f"v{i}") < 0, -F.col(f"b{i}") - 1).when(F.col(f"v{i}").isNotNull(), F.col(f"b{i}")).alias("key")) for i in n])
    return keyed.select(F.explode(cells).alias("c")).select("c.column", "c.key").filter("key IS NOT NULL")


def double_of(bits):
    return struct.unpack(">d", struct.pack(">q", bits ^ ((1 << 63) - 1) if bits < 0 else bits))[0]


def _any(prefix, spaces):
    """Whether a key lies in one of the spaces (column, bits so far)."""
    by_column = {}
    for i, p in spaces:
        by_column.setdefault(i, []).append(p)
    condition = F.lit(False)
    for i, prefixes in by_column.items():
        condition = condition | ((F.col("column") == i) & prefix.isin(prefixes))
    return condition


def order_statistics(df, values, probs):
    """{name: (rows with a value, {rank from 0: value})} with the ranks on both sides of each probability. values: {name: numeric column}."""
    # The four scans read the keys of one pass: what the values are derived from is worked out once.
    cells = ordered_bits(df, [values[c] for c in values]).persist()
    try:
        return _ranked(cells, list(values), probs)
    finally:
        cells.unpersist()


def _ranked(cells, names, probs):
    sizes, spaces = {}, {}          # spaces: {(column, bits so far): {rank: rows below the space}}
    for left in range(BITS - DIGIT, -1, -DIGIT):
        first = left == BITS - DIGIT
        prefix = F.lit(0).cast("long") if first else F.shiftright("key", left + DIGIT)
        rows = cells if first else cells.filter(_any(prefix, spaces))
        counts = rows.groupBy("column", prefix.alias("prefix"), F.shiftright("key", left).alias("digit")).agg(F.count("*").alias("n"))
        space = Window.partitionBy("column", "prefix")
        placed = counts.select("*", (F.sum("n").over(space.orderBy("digit")) - F.col("n")).alias("below"), F.sum("n").over(space).alias("total"))
        if first:
            at = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
            ranks = F.array_distinct(F.array(*[fn(x) for x in at for fn in (F.floor, F.ceil)]))
            asked = F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("inside")))
        else:
            asked = F.array(*[F.struct(F.lit(rank).cast("long").alias("rank"), F.when((F.col("column") == i) & (F.col("prefix") == p), F.lit(rank - below).cast("long")).alias("inside"))
                              for (i, p), ranks in spaces.items() for rank, below in ranks.items()])
        here = F.filter(asked, lambda t: (t["inside"] >= F.col("below")) & (t["inside"] < F.col("below") + F.col("n")))
        chosen = placed.select("column", "prefix", "digit", "below", "total", F.explode(here).alias("t")).select("column", "prefix", "digit", "below", "total", "t.rank").collect()
        following = {}
        for r in chosen:
            if first:
                sizes[r["column"]] = r["total"]
            below = 0 if first else spaces[r["column"], r["prefix"]][r["rank"]]
            following.setdefault((r["column"], r["digit"]), {})[r["rank"]] = below + r["below"]
        spaces = following
        if not spaces:
            break
    found = {c: (sizes.get(i, 0), {}) for i, c in enumerate(names)}
    for (i, key), ranks in spaces.items():
        found[names[i]][1].update({rank: double_of(key) for rank in ranks})
    return found


def _between(at, place):
    low, high = at[math.floor(place)], at[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


def exact_quantiles_of(df, values, probs):
    """{name: linear-interpolated quantiles} of all columns at once, None without rows. values: {name: column}; probs: a list, or {name: list}."""
    of = probs if isinstance(probs, dict) else dict.fromkeys(values, probs)
    found, out = order_statistics(df, values, sorted({p for ps in of.values() for p in ps})), {}
    for c in values:
        n, at = found[c]
        out[c] = [_between(at, (n - 1) * p) if n else None for p in of[c]]
    return out


def exact_quantiles(df, value, probs):
    """Linear-interpolated quantiles of ``value`` at ``probs`` as Python floats (None without rows)."""
    return exact_quantiles_of(df, {"v": value}, probs)["v"]
