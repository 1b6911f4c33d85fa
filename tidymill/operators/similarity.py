"""Near-equal values: edit distance and block-match ratio, over distinct values, without comparing all pairs.

Two ways to find candidates, both exact:

* *Deletion keys* for an edit distance of at most two: values within distance two share a string obtained by deleting at
  most two characters from each. A long common prefix does not bring unrelated values together.
* *Pieces* for a ratio threshold: if ``ratio(a, b) >= t`` then a and b differ by at most ``k = (1 - t)(|a| + |b|)``
  single-character insertions and deletions. Cut the shorter value into ``k + 1`` pieces; one of them survives untouched
  in the other value, shifted by at most ``k``.

Grouping needs connections, not all pairs: values that share a block so long that it alone proves the ratio are linked
to one hub per block, values equal outside one window are scored against one hub per window, and only candidates in
different groups of these are searched and scored.
"""
import os

from pyspark.sql import functions as F

from ..functions.udfs import match_ratio


def distinct_values(frame, column):
    return frame.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value is not null and value <> ''").distinct()


def _deletions(v, depth):
    """All strings left after deleting up to ``depth`` (0 to 2) characters."""
    def once(s):
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, 1, i - 1), s.substr(i + 1, F.length(s))))

    def guarded(s):
        return F.when(F.length(s) > 0, once(s)).otherwise(F.array().cast("array<string>"))

    one = guarded(v)
    levels = [F.array(v), one]
    if depth == 2:
        levels.append(F.flatten(F.transform(one, guarded)))
    return F.array_distinct(F.flatten(F.array(*levels[:depth + 1])))


def _keyed(values):
    """value, key, depth: every deletion key with the fewest deletions that reach it."""
    low = F.lower("value")
    levels = [F.array(low), _deletions(low, 1), _deletions(low, 2)]
    entries = F.flatten(F.array(*[F.transform(keys, lambda k, d=d: F.struct(k.alias("key"), F.lit(d).alias("depth")))
                                  for d, keys in enumerate(levels)]))
    return (values.select("value", F.explode(entries).alias("e")).groupBy("value", F.col("e.key").alias("key"))
            .agg(F.min("e.depth").alias("depth")))


def near(left, right=None):
    """Values of ``left`` that have a different value of ``right`` within two edits (``right`` defaults to ``left``).

    Deleting i characters from x and j from y to reach the same key proves a distance of at most i + j, so most values
    are settled by counting the members of their keys per depth. Only what stays open is compared, candidate by
    candidate; no group is expanded into all of its pairs.
    """
    own = right is None
    lk = _keyed(left)
    rk = lk if own else _keyed(right)
    held = rk.groupBy("key").agg(*[F.count_if(F.col("depth") <= d).alias(f"c{d}") for d in (0, 1, 2)])
    within = F.when(F.col("depth") == 0, F.col("c2")).when(F.col("depth") == 1, F.col("c1")).otherwise(F.col("c0"))
    itself = F.when(F.col("depth") <= 1, 1).otherwise(0) if own else F.lit(0)
    proven = lk.join(held, "key").filter(within - itself > 0).select("value").distinct()
    open_keys = lk.join(proven, "value", "left_anti").select("key", F.col("value").alias("a"))
    rest = (open_keys.join(rk.select("key", F.col("value").alias("b")), "key")
            .filter((F.col("a") != F.col("b")) & F.levenshtein(F.lower("a"), F.lower("b"), 2).between(0, 2))
            .select(F.col("a").alias("value")).distinct())
    return proven.unionByName(rest)


def near_values(frame, column):
    return near(distinct_values(frame, column))


def rows_with_value(frame, column, values, rid="_rid"):
    keyed = frame.select(F.col(rid).alias("_rid"), F.col(f"`{column}`").cast("string").alias("value"))
    return keyed.join(values, "value", "left_semi").select("_rid", "value")


# ---- ratio ----------------------------------------------------------------------------------------------------------

def _budget(total, threshold):
    """Most single-character insertions plus deletions two values of ``total`` characters may differ by."""
    return F.floor((1 - threshold) * total + 1e-9).cast("int")


def _pieces(threshold):
    """Pieces of a value when it is the shorter one of a pair.

    The longest partner has ``(2 - t)/t`` times its length, which bounds the budget, so one cut serves all partners.
    """
    n = F.length("key")
    k = _budget(n + F.floor(n * (2 - threshold) / threshold + 1e-9), threshold)
    parts = F.greatest(F.least(k + 1, n), F.lit(1))
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(
        F.floor(i * n / parts).cast("int").alias("at"),
        F.col("key").substr(F.floor(i * n / parts).cast("int") + 1,
                            F.floor((i + 1) * n / parts).cast("int") - F.floor(i * n / parts).cast("int")).alias("text")))


def _places(keys, widths):
    """Every substring of ``keys`` whose width some piece has: where that piece may reappear."""
    bounds = widths.agg(F.array_sort(F.collect_set("w")).alias("ws"))   # widths, not rows: at most the longest value
    spans = keys.select("*", F.length("key").alias("n"), bounds.scalar().alias("ws"))
    spans = spans.select("*", F.explode(F.filter("ws", lambda w: w <= F.col("n"))).alias("w"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w"))).alias("pos"))
    return spans.select(F.col("key").alias("b"), F.col("n").alias("nb"), "pb", "pos",
                        F.col("key").substr(F.col("pos") + 1, F.col("w")).alias("text"))


def candidate_pairs(short, long, threshold, strict=False, apart=False):
    """(a from ``short``, b from ``long``), |a| <= |b|, that may reach ``threshold``.

    Both frames have ``key`` and ``part``; pairs with equal ``part`` are already connected and are skipped. All bounds
    sit in the join condition, so a rejected pair is never emitted. ``apart``: parts are large, so pairs inside the part
    that holds most places of a text are not even looked at; one side of every other pair lies outside that part.
    """
    cut = short.select("key", F.col("part").alias("pa"), F.explode(_pieces(threshold)).alias("p")).select(
        F.col("key").alias("a"), "pa", F.length("key").alias("na"), F.col("p.at").alias("at"), F.col("p.text").alias("text"))
    places = _places(long.select("key", F.col("part").alias("pb")), cut.select(F.length("text").alias("w")).distinct())
    total = F.col("na") + F.col("nb")
    shorter = (F.col("na") < F.col("nb")) if strict else (F.col("na") <= F.col("nb"))
    fits = ((F.col("pa") != F.col("pb")) & shorter & (2 * F.col("na") >= threshold * total - 1e-9)
            & (F.abs(F.col("at") - F.col("pos")) <= _budget(total, threshold))
            & (2 * F.least(_shared_characters("a", "b"), _shared_characters("b", "a")) >= threshold * total - 1e-9))
    if not apart:
        return cut.join(places, "text").filter(fits).select("a", "b").distinct()
    held = places.groupBy("text", "pb").agg(F.count("*").alias("n")).groupBy("text").agg(F.max_by("pb", "n").alias("most"), (F.count("*") == 1).alias("one"))
    cut, places = cut.join(held, "text"), places.join(held.select("text", "most"), "text")
    outer = cut.filter("pa <> most").join(places.drop("most"), "text")
    inner = cut.filter("pa = most AND NOT one").join(places.filter("pb <> most").drop("most"), "text")
    return outer.filter(fits).select("a", "b").unionByName(inner.filter(fits).select("a", "b")).distinct()


def similar_to(left, right, threshold):
    """(a from ``left``, b from ``right``, ratio) with a block-match ratio of at least ``threshold``. Columns: key."""
    side = lambda df, mark: df.select("key", F.concat(F.lit(mark), "key").alias("part"))
    pairs = candidate_pairs(side(left, "l"), side(right, "r"), threshold).unionByName(
        candidate_pairs(side(right, "r"), side(left, "l"), threshold, strict=True).select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.filter("a <> b").withColumn("ratio", match_ratio("a", "b")).filter(F.col("ratio") >= threshold)


def _hub_edges(keys, threshold):
    """Edges that need no scoring: a shared block of at least ``threshold`` times either length proves the ratio.

    Each value lists its blocks of that length; all values of one block are linked to the smallest of them, so a block
    shared by a third of the values costs one edge per value.
    """
    n = F.length("key")
    least = F.greatest(F.ceil(threshold * n - 1e-9).cast("int"), F.lit(1))
    blocks = keys.select("key", n.alias("n"), F.explode(F.sequence(least, n)).alias("w"))
    blocks = blocks.select("key", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w"))).alias("pos"))
    blocks = blocks.select("key", F.col("key").substr(F.col("pos") + 1, F.col("w")).alias("block")).distinct()
    hubs = blocks.groupBy("block").agg(F.min("key").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return blocks.join(hubs, "block").filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()


def _likely_edges(keys, threshold):
    """Edges worth scoring first: each key with the smallest key that equals it outside one window as wide as the threshold allows.

    One edge per key and window. They join most of what belongs together, so that few pairs are left for the exact search.
    """
    n = F.length("key")
    widest = F.floor((1 - threshold) * n + 1e-9).cast("int")
    windows = keys.select("key", n.alias("n"), F.explode(F.sequence(F.greatest(widest - 1, F.lit(0)), widest)).alias("w"))
    windows = windows.select("key", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("w"))).alias("pos"))
    rest = F.concat(F.col("key").substr(F.lit(1), F.col("pos")), F.col("key").substr(F.col("pos") + F.col("w") + 1, F.col("n")))
    left = windows.select("key", F.xxhash64("pos", rest).alias("rest"))     # scored afterwards, so two rests of one hash do no harm
    hubs = left.groupBy("rest").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub <> last")
    return left.join(hubs, "rest").filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()


def _reach(pairs, threshold):
    return pairs.filter(F.greatest(match_ratio("a", "b"), match_ratio("b", "a")) >= threshold)


def similar_groups(keys, threshold):
    """key -> root of its group: keys connected by a chain of pairs that reach ``threshold``.

    Pairs are searched in full only between groups that proven blocks and likely edges leave apart.
    """
    vertices = keys.select(F.col("key").alias("vertex"))
    joined = components(vertices, _hub_edges(keys, threshold).unionByName(_reach(_likely_edges(keys, threshold), threshold)))
    parts = joined.select(F.col("vertex").alias("key"), F.col("root").alias("part"))
    scored = _reach(candidate_pairs(parts, parts, threshold, apart=True).filter("a <> b"), threshold)
    links = joined.select(F.col("vertex").alias("a"), F.col("root").alias("b")).filter("a <> b")
    return components(vertices, scored.unionByName(links))


def _shared_characters(a, b):
    """Upper bound on matched characters: characters of ``a`` that occur in ``b``."""
    return F.length(F.expr(f"translate({a}, translate({a}, {b}, ''), '')"))


def components(vertices, edges, checkpoint=None, max_rounds=60):
    """Connected components: vertex -> smallest vertex of its component.

    Large-star / small-star rounds: every round links each vertex to the smallest vertex it can see, which halves the
    depth. Lineage is cut by writing each second round to the cluster's checkpoint folder.
    """
    spark = edges.sparkSession
    cut = checkpoint or checkpointer(spark)
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        downs = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = downs.groupBy("u").agg(F.min("v").alias("m"))
        small = (downs.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).filter("u <> v").distinct())
        small = cut(small)
        before, after = _signature(pairs), _signature(small)
        pairs = small
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return vertices.select("vertex").join(roots, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def _signature(pairs):
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def checkpointer(spark):
    """Reliable checkpoint in the folder the cluster names; a session in one process may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not spark.sparkContext.getCheckpointDir():
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile
            folder = tempfile.mkdtemp(prefix="spark-")     # one process: its own folder is shared by all tasks
        spark.sparkContext.setCheckpointDir(folder)
    return lambda df: df.checkpoint(eager=True)


def variant_groups(frame, column, threshold, key=None, pick="longest"):
    """Groups of spellings that belong together: value, canonical. Only groups with at least two spellings.

    ``key`` is the expression compared (lower case by default). The canonical spelling is the longest one (ties: the
    alphabetically first), or with ``pick='first'`` the alphabetically first.
    """
    key = F.lower("value") if key is None else key
    values = distinct_values(frame, column).withColumn("key", key)
    values = checkpointer(frame.sparkSession)(values)
    # exact block rule: equal keys need no scoring
    keys = values.select(F.col("key").alias("vertex")).distinct()
    roots = similar_groups(keys.withColumnRenamed("vertex", "key"), threshold)
    placed = values.join(roots, values["key"] == roots["vertex"]).select("value", "key", "root")
    order = F.struct(-F.length("key"), F.col("value")) if pick == "longest" else F.struct(F.col("key"), F.col("value"))
    best = placed.groupBy("root").agg(F.min_by("value", order).alias("canonical"), F.count("*").alias("n")).filter("n > 1")
    return placed.join(best, "root").select("value", "canonical")


def apply_variants(frame, column, groups, out):
    """Replace every spelling by its canonical one."""
    pairs = groups.select(F.col("value").alias("_value"), F.col("canonical").alias("_canonical"))
    return (frame.join(pairs, F.col(f"`{column}`") == F.col("_value"), "left")
            .withColumn(out, F.coalesce("_canonical", F.col(f"`{column}`"))).drop("_value", "_canonical"))
