"""Exact, partial, temporal and fuzzy duplicates. No row or pair limits."""
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import FUZZY_THRESHOLD, FUZZY_WEIGHTS, SPOKEN_SOUNDS
from ..functions.text import folded, squeeze
from .similarity import checkpointer, components


def _others(df, rid):
    return [c for c in df.columns if c != rid]


def drop_exact(df, rid="_rid"):
    """DUP-EXACT: one row per set of rows equal as text (nulls equal nulls): the first by row id.

    Grouping combines copies before the shuffle, so a group with a third of all rows costs one row per task.
    """
    cols = _others(df, rid)
    text = [F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(cols)]
    keyed = df.select(*text, F.struct(F.col(rid), *[F.col(f"`{c}`") for c in cols]).alias("row"))
    first = keyed.groupBy(*[f"k{i}" for i in range(len(cols))]).agg(F.min_by("row", F.col("row").getField(rid)).alias("row"))
    return first.select("row.*")


def exact_groups(df, rid="_rid"):
    """DUP-EXACT: kept row and number of copies, for rows that have copies."""
    text = [F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(_others(df, rid))]
    return (df.select(F.col(rid).alias("_rid"), *text).groupBy(*[f"k{i}" for i in range(len(text))])
            .agg(F.min("_rid").alias("kept_rid"), F.count("*").alias("n_rows")).filter("n_rows > 1").select("kept_rid", "n_rows"))


def _keys(keys):
    return [folded(F.col(f"`{k}`").cast("string")).alias(f"key_{k}") for k in keys]


def partial_groups(df, keys, rid="_rid"):
    """DUP-PARTIAL: rows with the same key that differ elsewhere; mergeable when no column holds two different values."""
    rest = [c for c in _others(df, rid) if c not in keys]
    text = {c: F.col(f"`{c}`").cast("string") for c in rest}
    named = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys]))
    g = named.groupBy(*_keys(keys)).agg(
        F.count("*").alias("n_rows"), F.min(rid).alias("first_rid"),
        F.array_compact(F.array(*[F.when(F.min(t) != F.max(t), F.lit(c)) for c, t in text.items()])).alias("conflicts"),
        F.array_compact(F.array(*[F.when(F.count(t).between(1, F.count("*") - 1), F.lit(c)) for c, t in text.items()])).alias("gaps"))
    return (g.filter((F.col("n_rows") > 1) & ((F.size("conflicts") > 0) | (F.size("gaps") > 0)))
            .withColumn("can_merge", F.size("conflicts") == 0))


def merged_rows(df, keys, rid="_rid"):
    """DUP-MERGE: one row per mergeable group: the first row, its nulls filled from later rows, and which were filled."""
    rest = [c for c in _others(df, rid) if c not in keys]
    groups = partial_groups(df, keys, rid).filter("can_merge").select(*[f"key_{k}" for k in keys])
    keyed = df.select("*", *_keys(keys)).join(groups, [f"key_{k}" for k in keys], "left_semi")
    at = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.col(rid))
    merged = keyed.groupBy(*[f"key_{k}" for k in keys]).agg(
        F.min(rid).alias(rid), F.count("*").alias("n_rows"), *[F.min_by(F.col(f"`{k}`"), F.col(rid)).alias(k) for k in keys],
        *[F.min_by(F.col(f"`{c}`"), at(c)).alias(c) for c in rest], *[F.min(at(c)).alias(f"from_{c}") for c in rest])
    filled = F.array_compact(F.array(*[F.when(F.col(f"`from_{c}`") > F.col(rid), F.lit(c)) for c in rest]))
    return merged.select(rid, *[F.col(f"`{c}`") for c in (*keys, *rest)], "n_rows", filled.alias("filled_columns"))


def temporal_groups(df, keys, dates, rid="_rid"):
    """DUP-TEMPORAL: keys seen at more than one moment."""
    moment = F.struct(*[F.col(f"`{d}`") for d in dates])
    named = df.filter(reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in keys]))
    counted = named.groupBy(*_keys(keys), moment.alias("_m")).agg(F.count("*").alias("_n"))
    return (counted.groupBy(*[f"key_{k}" for k in keys]).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_moments"))
            .filter("n_moments > 1"))


# ---- fuzzy -------------------------------------------------------------------------------------------------------------

def sound(v):
    return reduce(lambda x, p: F.regexp_replace(x, *p), SPOKEN_SOUNDS, F.lower(F.trim(v)))


def _likeness(a, b):
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def comparison_texts(df, names, ids=(), contacts=(), rid="_rid"):
    """_rid, block, and per component the texts it is compared by (null when missing)."""
    joined = lambda cs: F.nullif(F.concat_ws(" ", *[F.trim(F.col(f"`{c}`").cast("string")) for c in cs]), F.lit(""))
    name = squeeze(F.lower(joined(names)))
    base = df.select(F.col(rid).alias("_rid"), name.alias("name_0"), *([joined(ids).alias("id_0")] if ids else []),
                     *[F.nullif(F.lower(F.trim(F.col(f"`{c}`").cast("string"))), F.lit("")).alias(f"contact_{i}") for i, c in enumerate(contacts)])
    return base.select("*", sound(F.col("name_0")).alias("name_1"), F.array_join(F.array_sort(F.split("name_0", " ")), " ").alias("name_2"),
                       F.substring("name_0", 1, 3).alias("block")).filter("name_0 is not null")


def _components(texts):
    cols = [c for c in texts.columns if c not in ("_rid", "block")]
    return {k: [c for c in cols if c.startswith(k + "_")] for k in FUZZY_WEIGHTS if any(c.startswith(k + "_") for c in cols)}


def pair_score(parts, a, b):
    """DUP-SCORE: weighted mean over the components both sides have; per component the best of its texts."""
    sims = {k: F.greatest(*[F.when(F.col(f"{a}.{t}").isNotNull() & F.col(f"{b}.{t}").isNotNull(), _likeness(F.col(f"{a}.{t}"), F.col(f"{b}.{t}"))) for t in ts],
                          F.lit(None).cast("double")) for k, ts in parts.items()}
    weight = reduce(lambda x, y: x + y, [F.when(s.isNotNull(), FUZZY_WEIGHTS[k]).otherwise(0.0) for k, s in sims.items()])
    total = reduce(lambda x, y: x + y, [F.coalesce(s * FUZZY_WEIGHTS[k], F.lit(0.0)) for k, s in sims.items()])
    return total / weight


#: Letters that the records of a block share: they lengthen the first piece of a text. Texts up to WINDOWED letters look for pieces
#: only where an edit can have moved them. Components of at most SHORT letters may be searched by deleting one letter.
BLOCK_LETTERS, WINDOWED, SHORT = 3, 128, 12


def _edits(n, least):
    return int((1 - least) * n + 1e-9)


def _most_edits(n, least):
    """Edits to any partner, also a longer one."""
    return int((1 - least) / least * n + 1e-9) if least > 0 else n


def _edges(n, least):
    """Where a text of n letters is cut: k edits to any partner leave one of k + 1 pieces whole. One empty piece where no letter need stay."""
    k = _most_edits(n, least)
    if k >= n:
        return [0, 0]
    lead = min(BLOCK_LETTERS, n - k - 1)
    return [0] + [lead + i * (n - lead) // (k + 1) for i in range(1, k + 2)]


def _pieces(text, least):
    """The pieces of ``_edges`` as an array."""
    n = F.length(text)
    k = F.floor((1 - least) / least * n + 1e-9).cast("int") if least > 0 else n
    lead = F.least(F.lit(BLOCK_LETTERS), n - k - 1)
    edge = lambda i: F.when((i == 0) | (k >= n), 0).otherwise(lead + F.floor(i * (n - lead) / (k + 1)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.when(k >= n, 0).otherwise(k)), lambda i: F.col(text).substr(edge(i) + 1, edge(i + 1) - edge(i)))


def _windows(lengths, least, both):
    """(m, at, w): where a text of m letters may hold a piece, w wide, of a text of another of ``lengths`` (longer ones only with ``both``).

    The first piece that stays whole with as many edits before it as there are pieces before it is i; it has moved by at
    most i, and what is left of the edits must make up for the difference in length behind it.
    """
    found = set()
    for m in (m for m in lengths if m <= WINDOWED):
        for n in lengths:
            edits = _edits(max(m, n), least)
            if abs(m - n) > edits or (n > m and not both):
                continue
            edges = _edges(n, least)
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                for at in range(a + max(-i, m - n - edits + i), a + min(i, m - n + edits - i) + 1):
                    if 0 <= at <= m - (b - a):
                        found.add((m, at, b - a))
    return sorted(found)


def _cut(df, text, least, lengths):
    """A row per piece of ``text``; where a piece stands is looked up by the text's length, only long texts are cut by an expression."""
    edges = {n: _edges(n, least) for n in lengths if n <= WINDOWED}
    cuts = df.sparkSession.createDataFrame([(n, a, b - a) for n, e in edges.items() for a, b in zip(e, e[1:])], "m int, at int, w int")
    cut = df.join(F.broadcast(cuts), F.length(text) == F.col("m")).withColumn("piece", F.col(text).substr(F.col("at") + 1, F.col("w"))).drop("m", "at", "w")
    if max(lengths) > WINDOWED:
        cut = cut.unionByName(df.filter(F.length(text) > WINDOWED).withColumn("piece", F.explode(_pieces(text, least))))
    return cut


def _one_deleted(df, text, longest):
    """A row for ``text`` itself and for every letter deleted from it, as ``piece``."""
    at = df.sparkSession.createDataFrame([(n, i) for n in range(longest + 1) for i in range(n + 1)], "m int, at int")
    left = F.when(F.col("at") == 0, F.col(text)).otherwise(F.concat(F.col(text).substr(F.lit(1), F.col("at") - 1), F.col(text).substr(F.col("at") + 1, F.col("m"))))
    return df.join(F.broadcast(at), F.length(text) == F.col("m")).withColumn("piece", left).drop("m", "at")


def _text_pairs(cut, looked, text, least, lengths, both=False):
    """Pairs of a record of ``cut`` and one of ``looked`` in one block whose ``text`` reaches a likeness of ``least``.

    Only hashes of pieces, row ids and the text itself are shuffled, and the distance sits in the join condition. Without
    ``both`` the two frames are the same records and the text cut is the shorter one.
    """
    if not lengths:
        return cut.select(F.col("_rid").alias("rid_a"), F.col("_rid").alias("rid_b")).filter("false")
    key = lambda piece: F.xxhash64("block", piece).alias("key")
    left = _cut(cut.select(F.col("_rid").alias("rid_a"), F.col(text).alias("short"), "block"), "short", least, lengths).select("rid_a", "short", key("piece"))
    long = looked.filter(F.col(text).isNotNull()).select(F.col("_rid").alias("rid_b"), F.col(text).alias("long"), "block", F.length(text).alias("m"))
    windows = cut.sparkSession.createDataFrame(_windows(lengths, least, both), "m int, at int, w int")
    spots = long.join(F.broadcast(windows), "m").select("rid_b", "long", "block", "at", "w")
    if max(lengths) > WINDOWED:
        wide = set()
        for n in lengths:
            k, first = _most_edits(n, least), _edges(n, least)[1]
            wide |= {first, *((n - min(BLOCK_LETTERS, n - k - 1)) // (k + 1) + d for d in (0, 1) if k < n)}
        far = long.filter(F.col("m") > WINDOWED).select("*", F.explode(F.lit(sorted(wide))).alias("w")).filter("w <= m")
        spots = spots.unionByName(far.select("rid_b", "long", "block", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("w"))).alias("at"), "w"))
    right = spots.select("rid_b", "long", key(F.col("long").substr(F.col("at") + 1, F.col("w"))))
    n, m = F.length("short"), F.length("long")
    k = F.floor((1 - least) * F.greatest(n, m) + 1e-9).cast("int")
    fits = (F.col("rid_a") != F.col("rid_b")) if both else ((n < m) | ((n == m) & (F.col("rid_a") < F.col("rid_b"))))
    near = (F.col("short") == F.col("long")) | F.levenshtein("short", "long", _edits(max(lengths), least)).between(F.lit(0), k)
    return (left.join(right, "key").filter(fits & (F.abs(n - m) <= k) & near)
            .select(F.least("rid_a", "rid_b").alias("rid_a"), F.greatest("rid_a", "rid_b").alias("rid_b")).distinct())


def _deletion_pairs(records, text, longest):
    """Pairs in one block whose ``text`` is at most one edit apart (a few more: the score decides)."""
    keyed = _one_deleted(records.select("_rid", "block", text), text, longest).select("_rid", F.xxhash64("block", "piece").alias("key"))
    a, b = keyed.select(F.col("_rid").alias("rid_a"), "key"), keyed.select(F.col("_rid").alias("rid_b"), "key")
    return a.join(b, "key").filter("rid_a < rid_b").select("rid_a", "rid_b").distinct()


def _costs(records, parts, floor, lengths):
    """Pairs that share a key, per component: one count for all of them."""
    keys = []
    for k, ts in parts.items():
        longest = max((n for t in ts for n in lengths[t]), default=0)
        for t in ts:
            if lengths[t]:
                made = _one_deleted(records.select("block", t), t, longest) if longest <= SHORT else _cut(records.select("block", t), t, floor[k], lengths[t])
                keys.append(made.select(F.lit(k).alias("part"), F.xxhash64("block", "piece", F.lit(t)).alias("key")))
    counts = reduce(DataFrame.unionByName, keys).groupBy("part", "key").agg(F.count("*").alias("n"))
    found = {r["part"]: r["c"] for r in counts.groupBy("part").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("c")).collect()}
    return {k: found.get(k, 0) for k in parts}


def fuzzy_pairs(df, names, ids=(), contacts=(), rid="_rid", threshold=FUZZY_THRESHOLD):
    """DUP-FUZZY: (rid_a, rid_b, score) of distinct records in the same three-letter block, score at least ``threshold``.

    Candidates are exact. The score is a weighted mean, so a pair that reaches 0.85 has at most 0.15 of weighted deficit.
    Shared out between two components, one of them keeps to its share: the two whose keys repeat least are searched (a
    name or contact shared by a third of the rows is left out), each at the likeness its share allows. Shares are equal,
    but short texts get less than two edits, which keys with one letter deleted find, and the other component the rest.
    Pairs with a missing component always have the name: it is searched alone at the likeness the whole deficit allows.
    """
    texts = comparison_texts(df, names, ids, contacts, rid)
    parts = _components(texts)
    cols = [t for ts in parts.values() for t in ts]
    present = reduce(lambda a, b: a & b, [reduce(lambda x, y: x & y, [F.col(t).isNotNull() for t in ts]) for ts in parts.values()])
    records = (texts.groupBy("block", *cols).agg(F.min("_rid").alias("_rid"), F.count("*").alias("copies")).withColumn("whole", present))
    records = checkpointer(df.sparkSession)(records)
    measured = records.agg(*[F.array_sort(F.collect_set(F.length(t))).alias(t) for t in cols], F.bool_or(~F.col("whole")).alias("gaps")).first()
    lengths = {t: list(measured[t]) for t in cols}
    weight = {k: FUZZY_WEIGHTS[k] for k in parts}
    deficit = (1 - threshold) * sum(weight.values())
    whole, chosen = records.filter("whole"), list(parts)
    if len(parts) > 2:
        costs = _costs(whole, parts, {k: max(1 - deficit / 2 / weight[k], 0.0) for k in parts}, lengths)
        chosen = sorted(parts, key=lambda k: costs[k])[:2]
    share = {k: deficit / len(chosen) for k in chosen}
    longest = {k: max((n for t in parts[k] for n in lengths[t]), default=0) for k in chosen}
    for k in chosen if len(chosen) == 2 else ():
        one_edit = weight[k] * 2 / max(longest[k], 1) * (1 - 1e-6)
        if longest[k] <= SHORT and one_edit < share[k]:
            share = {j: one_edit if j == k else deficit - one_edit for j in chosen}
            break
    found = []
    for k in chosen:
        least = max(1 - share[k] / weight[k], 0.0)
        for t in parts[k]:
            found.append(_deletion_pairs(whole, t, longest[k]) if longest[k] <= SHORT and _edits(longest[k], least) <= 1 else _text_pairs(whole, whole, t, least, lengths[t]))
    if measured["gaps"]:
        others = sum(w for k, w in weight.items()) - min((w for k, w in weight.items() if k != "name"), default=0.0)
        found += [_text_pairs(records, records.filter("not whole"), t, max(1 - (1 - threshold) * others / weight["name"], 0.0), lengths[t], both=True) for t in parts["name"]]
    pairs = reduce(DataFrame.unionByName, [p.select("rid_a", "rid_b") for p in found]).distinct()
    a = records.select(F.col("_rid").alias("rid_a"), F.struct("block", *cols).alias("a"))
    b = records.select(F.col("_rid").alias("rid_b"), F.struct("block", *cols).alias("b"))
    scored = pairs.join(a, "rid_a").join(b, "rid_b").filter("a.block = b.block").select("rid_a", "rid_b", pair_score(parts, "a", "b").alias("score"))
    # Rows whose compared texts are equal link to the first of them, one pair per row.
    keys = ["block", *cols]
    heads = records.filter("copies > 1").select(*[F.col(c).alias(f"h_{c}") for c in keys], F.col("_rid").alias("rid_a"))
    equal = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in keys])
    copies = texts.join(heads, equal).filter("_rid <> rid_a").select("rid_a", F.col("_rid").alias("rid_b"), F.lit(1.0).alias("score"))
    return scored.filter(F.col("score") >= threshold - 1e-12).unionByName(copies)


def fuzzy_groups(df, names, ids=(), contacts=(), rid="_rid", threshold=FUZZY_THRESHOLD):
    """DUP-FUZZY: _rid and group (the smallest row id in it), for groups of at least two rows."""
    texts = comparison_texts(df, names, ids, contacts, rid)
    cols = [c for c in texts.columns if c != "_rid"]
    heads = texts.groupBy(*cols).agg(F.min("_rid").alias("vertex"))
    key = F.xxhash64(*cols)
    pairs = checkpointer(df.sparkSession)(fuzzy_pairs(df, names, ids, contacts, rid, threshold).select(F.col("rid_a").alias("a"), F.col("rid_b").alias("b")))
    roots = components(heads.select("vertex"), pairs)
    same = reduce(lambda x, y: x & y, [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in cols])
    rows = (texts.withColumn("_h", key).alias("t").join(heads.withColumn("_h", key).alias("h"), (F.col("t._h") == F.col("h._h")) & same)
            .select("t._rid", "h.vertex").join(roots, "vertex").select("_rid", F.col("root").alias("group_id")))
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(sizes.select("group_id"), "group_id", "left_semi")


def summary(df, keys=None, dates=None, rid="_rid", fuzzy=None):
    """DUP-SUMMARY: type, groups, rows; exact copies are removed, the other groups are for review."""
    parts = [exact_groups(df, rid).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("n_rows")).select(F.lit("exact").alias("kind"), "n_groups", "n_rows")]
    count = lambda g, kind: g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")).select(F.lit(kind).alias("kind"), "n_groups", "n_rows")
    if keys:
        parts.append(count(partial_groups(df, keys, rid), "partial"))
    if keys and dates:
        parts.append(count(temporal_groups(df, keys, dates, rid), "temporal"))
    if fuzzy is not None:
        parts.append(count(fuzzy.groupBy("group_id").agg(F.count("*").alias("n_rows")), "fuzzy"))
    return reduce(DataFrame.unionByName, parts)
