"""The contract every column cleaner follows.

A cleaner declares, per column, an ordered list of steps: *changes* (always applied), *derived* columns, *flags* (a
finding about a row; never changes data) and *notes* (a finding about the column). ``apply_rules`` turns the steps of
all columns into one staged projection, so that a table with many columns is still read once:

* step ``k`` of every column goes into the same ``select``; no step copies the data;
* statistics a step needs (quantiles, majority votes) are gathered for all columns in one aggregate, one row;
* the cleaned table, the flags and the audit are three lazy views of the staged projection. Columns that a view does not
  use are pruned, so asking only for the table costs nothing for the audit.

Flags that depend on how often a value occurs are separate frames (``keyed_flag``): a count by key, then a semi join.
They never enter the plan of the cleaned table.
"""
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..plans.quantiles import exact_quantiles_of

FLAG_SCHEMA = "_rid bigint, rule string, column string, value string"


@dataclass
class Cell:
    """What a step sees: the current value, the original value, other columns, and the measured statistics."""
    column: str
    raw: object
    stat: dict
    current: dict
    bound: dict = field(default_factory=dict)

    def _slot(self, slot):
        return self.bound[slot] if slot in self.bound else F.col(f"`{slot}`")

    @property
    def v(self):
        return self._slot(self.current[self.column])

    def other(self, name):
        """Current value of another column."""
        return self._slot(self.current.get(name, name))

    def get(self, name):
        """A helper value set by ``ColumnRules.let``."""
        return self._slot(self.current[self.column + "." + name])


def evaluate(fn, cell):
    """The step's expression, mentioning every staged input once.

    The optimizer inlines staged columns into filters and joins. An input mentioned ten times per step would be copied
    ten-fold per step; bound to a variable it is copied once, so the plan grows with the number of steps only.
    """
    plain = fn(cell)
    if plain is None:
        return None
    text = repr(plain)
    used = sorted({s for s in cell.current.values() if s.endswith("~") and s in text})
    if all(text.count(s) == 1 for s in used):
        return plain
    inputs = F.struct(*[F.col(f"`{s}`").alias(f"i{k}") for k, s in enumerate(used)])
    return let(inputs, lambda row: fn(Cell(cell.column, cell.raw, cell.stat, cell.current,
                                           {s: row.getField(f"i{k}") for k, s in enumerate(used)})))


@dataclass
class ColumnRules:
    column: str
    waves: list = field(default_factory=lambda: [[]])
    barriers: list = field(default_factory=list)
    keyed: list = field(default_factory=list)
    notes: list = field(default_factory=list)

    def change(self, rule, fn):
        self.waves[-1].append(("change", rule, None, fn))
        return self

    def derive(self, rule, suffix, fn):
        """New column ``<column>_<suffix>``."""
        self.waves[-1].append(("derive", rule, f"{self.column}_{suffix}", fn))
        return self

    def let(self, name, fn):
        """Helper value, computed once and read by several later steps through ``cell.get(name)``; not in the output."""
        self.waves[-1].append(("let", None, f"{self.column}.{name}", fn))
        return self

    def flag(self, rule, fn):
        self.waves[-1].append(("flag", rule, None, fn))
        return self

    def measure(self, quantiles=None, **aggregates):
        """Gather statistics of the value as it is at this point; later steps read them from ``cell.stat``."""
        self.barriers.append(("measure", aggregates, quantiles))
        self.waves.append([])
        return self

    def join(self, rule, fn):
        """A change that needs a join: ``fn(frame, value_column, new_column) -> frame``."""
        self.barriers.append(("join", rule, fn))
        self.waves.append([])
        return self

    def keyed_flag(self, rule, fn):
        """``fn(frame, value_column, current) -> DataFrame(_rid, value)`` for the rows to flag."""
        self.keyed.append((rule, fn))
        return self

    def note(self, rule, fn):
        """``fn(stat) -> text or None``: one finding about the whole column."""
        self.notes.append((rule, fn))
        return self


@dataclass
class CleanResult:
    staged: DataFrame
    rid: str
    columns: dict            # final column name -> staged column name, in output order
    changes: list            # (rule, final column name, staged before, staged after)
    row_flags: list          # (rule, column, staged boolean column, staged value column)
    keyed_flags: list        # (rule, column, DataFrame(_rid, value))
    column_notes: list       # (rule, column, text)
    stats: dict

    @property
    def table(self) -> DataFrame:
        return self.staged.select(self.rid, *[F.col(f"`{s}`").alias(c) for c, s in self.columns.items()])

    @property
    def annotated(self) -> DataFrame:
        """The table plus ``flags``: the ids of the rules that flagged the row, comma-separated."""
        ids = [F.when(F.col(f"`{b}`"), F.lit(rule)) for rule, _, b, _ in self.row_flags]
        return self.staged.select(self.rid, *[F.col(f"`{s}`").alias(c) for c, s in self.columns.items()],
                                  F.concat_ws(",", *ids).alias("flags") if ids else F.lit("").alias("flags"))

    @property
    def flags(self) -> DataFrame:
        spark = self.staged.sparkSession
        parts = []
        if self.row_flags:
            entries = F.array_compact(F.array(*[
                F.when(F.col(f"`{b}`"), F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column"),
                                                 F.col(f"`{v}`").cast("string").alias("value")))
                for rule, col, b, v in self.row_flags]))
            parts.append(self.staged.select(F.col(self.rid).cast("long").alias("_rid"), F.inline(entries)))
        for rule, col, frame in self.keyed_flags:
            parts.append(frame.select(F.col("_rid").cast("long").alias("_rid"), F.lit(rule).alias("rule"),
                                      F.lit(col).alias("column"), F.col("value").cast("string").alias("value")))
        notes = [(None, rule, col, text) for rule, col, text in self.column_notes]
        parts.append(spark.createDataFrame(notes, FLAG_SCHEMA))
        return reduce(DataFrame.unionByName, parts)

    @property
    def audit(self) -> DataFrame:
        entries = [
            F.when(~F.col(f"`{old}`").cast("string").eqNullSafe(F.col(f"`{new}`").cast("string")),
                   F.struct(F.lit(rule).alias("rule"), F.lit(col).alias("column"),
                            F.col(f"`{old}`").cast("string").alias("old_value"),
                            F.col(f"`{new}`").cast("string").alias("new_value")))
            for rule, col, old, new in self.changes]
        if not entries:
            return self.staged.sparkSession.createDataFrame(
                [], f"{self.rid} bigint, rule string, column string, old_value string, new_value string")
        return self.staged.select(self.rid, F.inline(F.array_compact(F.array(*entries))))

    def rule_counts(self) -> DataFrame:
        """rule, column, n_changed, n_flagged: what the job did, one row per rule that fired."""
        changed = self.audit.groupBy("rule", "column").agg(F.count("*").alias("n_changed"))
        flagged = self.flags.groupBy("rule", "column").agg(F.count("*").alias("n_flagged"))
        return (changed.join(flagged, ["rule", "column"], "full_outer")
                .select("rule", "column", F.coalesce("n_changed", F.lit(0).cast("long")).alias("n_changed"),
                        F.coalesce("n_flagged", F.lit(0).cast("long")).alias("n_flagged")))

    def saved(self, path) -> "CleanResult":
        """Write the staged projection once; all views then read it back instead of recomputing it."""
        self.staged.write.mode("overwrite").parquet(path)
        stored = self.staged.sparkSession.read.parquet(path)
        return CleanResult(stored, self.rid, self.columns, self.changes, self.row_flags, self.keyed_flags,
                           self.column_notes, self.stats)


def apply_rules(df, rules, rid="_rid") -> CleanResult:
    frame, current = df, {c: c for c in df.columns if c != rid}
    out_columns = dict(current)
    changes, flags, keyed, notes, serial = [], [], [], [], 0
    stats = {r.column: {} for r in rules}

    def staged_name(column):
        nonlocal serial
        serial += 1
        return f"{column}~{serial}~"

    for wave in range(max((len(r.waves) for r in rules), default=0)):
        active = [r for r in rules if wave < len(r.waves)]
        for depth in range(max(len(r.waves[wave]) for r in active)):
            batch = {}
            before = dict(current)
            for r in active:
                if depth >= len(r.waves[wave]):
                    continue
                kind, rule, name, fn = r.waves[wave][depth]
                new = evaluate(fn, Cell(r.column, F.col(f"`{r.column}`"), stats[r.column], before))
                if new is None:
                    continue
                slot = staged_name(name or r.column)
                if kind == "flag":
                    batch[slot] = F.coalesce(new.cast("boolean"), F.lit(False))
                    flags.append((rule, r.column, slot, before[r.column]))
                elif kind == "change":
                    batch[slot] = new
                    changes.append((rule, r.column, before[r.column], slot))
                    current[r.column] = out_columns[r.column] = slot
                elif kind == "let":
                    batch[slot] = new
                    current[name] = slot
                else:
                    batch[slot] = new
                    current[name] = out_columns[name] = slot
            if batch:
                frame = frame.select("*", *[c.alias(n) for n, c in batch.items()])
        measured = [(r, r.barriers[wave]) for r in active if wave < len(r.barriers)]
        aggregates, quantiles, targets = [], {}, []
        for r, barrier in measured:
            if barrier[0] == "measure":
                cell = Cell(r.column, F.col(f"`{r.column}`"), stats[r.column], current)
                for name, fn in barrier[1].items():
                    targets.append((r.column, name))
                    aggregates.append(fn(cell).alias(f"m{len(aggregates)}"))
                if barrier[2]:
                    quantiles[r.column] = (F.col(f"`{current[r.column]}`"), barrier[2])
        if aggregates:
            row = frame.agg(*aggregates).first()
            for (column, name), value in zip(targets, row):
                stats[column][name] = value
        if quantiles:
            found = exact_quantiles_of(frame, {c: value for c, (value, _) in quantiles.items()}, {c: probs for c, (_, probs) in quantiles.items()})
            for column, values in found.items():
                stats[column]["quantiles"] = values
        for r, barrier in measured:
            if barrier[0] == "join":
                slot = staged_name(r.column)
                frame = barrier[2](frame, current[r.column], slot)
                changes.append((barrier[1], r.column, current[r.column], slot))
                current[r.column] = out_columns[r.column] = slot
    for r in rules:
        keyed += [(rule, r.column, fn(frame, current[r.column], current)) for rule, fn in r.keyed]
        for rule, fn in r.notes:
            text = fn(stats[r.column])
            if text:
                notes.append((rule, r.column, str(text)))
    return CleanResult(frame, rid, out_columns, changes, flags, keyed, notes, stats)


# ---- reusable steps ------------------------------------------------------------------------------------------------

def repeated_rows(frame, column, rid="_rid", by=None, at_least=2):
    """Rows whose value (lower/trim not applied here) occurs ``at_least`` times: count by key, then semi join.

    The count combines before the shuffle, so one value holding a third of the rows costs one row per task; the join
    keeps the big side in place and is split by adaptive execution when the key is hot.
    """
    key = by if by is not None else F.col(f"`{column}`")
    keyed = frame.select(F.col(rid).alias("_rid"), key.alias("_key"), F.col(f"`{column}`").cast("string").alias("value"))
    hot = (keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("_n"))
           .filter(F.col("_n") >= at_least))
    return keyed.join(hot, "_key", "left_semi").select("_rid", "value")


def shared_rows(frame, column, owner, rid="_rid"):
    """Rows whose value belongs to more than one distinct owner."""
    keyed = frame.select(F.col(rid).alias("_rid"), F.col(f"`{column}`").alias("_key"), F.col(f"`{owner}`").alias("_owner"),
                         F.col(f"`{column}`").cast("string").alias("value"))
    known = keyed.filter(F.col("_key").isNotNull() & F.col("_owner").isNotNull())
    hot = (known.groupBy("_key").agg(F.min("_owner").alias("_a"), F.max("_owner").alias("_b"))
           .filter(F.col("_a") != F.col("_b")))
    return keyed.join(hot.select("_key"), "_key", "left_semi").select("_rid", "value")


def value_counts(frame, column):
    return (frame.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("value"))
            .agg(F.count("*").alias("n")))


def rare_rows(frame, column, share, rid="_rid"):
    """Rows whose value makes up less than ``share`` of the non-null rows."""
    counts = value_counts(frame, column)
    total = counts.agg(F.sum("n").alias("total"))
    rare = counts.filter(F.col("n") < share * total.scalar())
    keyed = frame.select(F.col(rid).alias("_rid"), F.col(f"`{column}`").alias("value"))
    return keyed.join(rare.select("value"), "value", "left_semi").select("_rid", "value")


def null_note(rule):
    """Column finding: how many values are missing. Needs a measure named ``nulls``."""
    return rule, lambda s: f"{s['nulls']} missing" if s.get("nulls") else None


def count_nulls(cell):
    return F.count_if(cell.v.isNull())
