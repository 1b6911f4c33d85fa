"""The end-to-end path on small and odd tables, and operators on skewed keys."""
import pytest
from pyspark.sql import functions as F

from tidymill.functions.text import capitalised
from tidymill.operators import duplicates, validation
from tidymill.plans import ordered
from tidymill.plans.full_clean import clean_table
from tidymill.plans.profile import profile_columns
from tidymill.sources.reader import header_cells


@pytest.mark.parametrize("columns, rows", [
    ("remarks string", [("fine",), (None,), ("",)]),
    ("a string, b double, c date", [(None, None, None)]),
    ("x int", []),
    ("status string, city string, country string", [("Active", "Paris", None), (None, None, "France")])])
def test_never_raises(spark, columns, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_rid long, {columns}")
    done = clean_table(df, "2024-01-01")
    for frame in (done.table, done.flags, done.audit, done.quality):
        frame.collect()


def test_amount_is_worked_out_before_means(spark):
    rows = [(i, str(q), str(p), None if i == 3 else str(q * p)) for i, (q, p) in enumerate([(1, 5), (2, 9), (4, 7), (3, 2), (5, 8), (6, 3)])]
    done = clean_table(spark.createDataFrame(rows, "_rid long, qty string, price string, amount string"), "2024-01-01")
    assert {r._rid: float(r.amount) for r in done.table.collect()}[3] == 6.0


def test_every_fill_is_audited(spark):
    df = spark.createDataFrame([(i, None if i == 2 else float(i), None if i == 4 else "ab"[i % 2]) for i in range(9)], "_rid long, x double, y string")
    lines = {(r.rule, r.column, r._rid, r.new_value) for r in clean_table(df, "2024-01-01").audit.filter("rule like 'PIPE%'").collect()}
    assert ("PIPE-07", "x", 2, "4.25") in lines and all(rid in (2, 4) for _, _, rid, _ in lines)


def test_no_checks_give_no_findings(spark):
    df = spark.createDataFrame([(1, "x")], "_rid long, remarks string")
    assert validation.violations(df, {}).count() == 0 and validation.check_summary(df, {}).count() == 0


def test_long_words_keep_their_letters(spark):
    assert spark.range(1).select(F.length(capitalised(F.repeat(F.lit("a"), 1_500_000)))).first()[0] == 1_500_000


def test_samples_come_from_all_rows(spark):
    df = spark.range(1000).select(F.col("id").alias("_rid"), F.when(F.col("id") > 900, "late").alias("c"))
    assert profile_columns(df).first()["samples"] == ["late"]


def test_null_order_keys_are_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("_rid"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("k"), F.lit(1).alias("v"))
    sizes = [r["count"] for r in ordered.with_ranges(df, ["k", "_rid"], 8).groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 900
    total = ordered.running_total(df, ["k", "_rid"], "v", "t", 8).orderBy("k", "_rid").collect()
    assert [r.t for r in total] == list(range(1, 3001))


def test_equal_records_are_a_pair(spark):
    rows = [(1, "Anna Maria Stone", "ID1", "a@b.org"), (2, "Anna Maria Stone", "ID1", "a@b.org"), (3, "Peter Quill", "ID9", "p@q.org")]
    df = spark.createDataFrame(rows, "_rid long, name string, code string, email string")
    assert [tuple(r) for r in duplicates.fuzzy_pairs(df, ["name"], ["code"], ["email"]).collect()] == [(1, 2, 1.0)]


def test_header_with_quotes():
    assert header_cells('a,"b, c",d', ",") == ["a", "b, c", "d"]


def test_numbers_and_dates_get_their_rules(spark):
    """Columns that are no text go through their formula set and keep their type."""
    rows = [(i, -5.0 if i < 8 else 100.25 + i, "2020-01-%02d" % (i % 28 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "_rid long, price double, hired string").withColumn("hired", F.to_date("hired"))
    done = clean_table(df, "2024-01-01")
    assert {r.formula_set for r in done.types.filter("column = 'price'").collect()} == {"AMT"}
    assert {r._rid for r in done.flags.filter("column = 'price' AND _rid IS NOT NULL").collect()} >= set(range(8))
    kinds = dict(done.table.dtypes)
    assert kinds["price"] == "double" and {r.price for r in done.table.collect()} == {r[1] for r in rows}


def test_determined_values_before_guesses_and_all_audited(spark):
    """Quantity times price wins over the value of a row above; each filled cell has one line."""
    rows = [(i, float(i % 4 + 1), i + 2.5, (i % 4 + 1) * (i + 2.5) if i % 3 == 0 else None) for i in range(30)]
    done = clean_table(spark.createDataFrame(rows, "_rid long, quantity double, price double, amount double"), "2024-01-01")
    assert {r._rid: r.amount for r in done.table.collect()} == {i: q * p for i, q, p, _ in rows}
    lines = [tuple(r) for r in done.audit.filter("column = 'amount' AND old_value IS NULL").select("_rid", "rule").collect()]
    assert sorted(lines) == [(i, "MV-AMOUNT") for i, _, _, a in rows if a is None]


def test_labels_are_filled_with_lines(spark):
    rows = [(i, "north" if i == 0 else "south" if i == 10 else None, f"item {i}") for i in range(20)]
    done = clean_table(spark.createDataFrame(rows, "_rid long, block string, item string"), "2024-01-01")
    lines = {(r._rid, r.new_value.lower()) for r in done.audit.filter("rule IN ('STRUCT-02', 'GLOBAL-13')").collect()}
    assert lines == {(i, "north" if i < 10 else "south") for i in range(20) if i not in (0, 10)}


def test_totals_and_contradictory_statuses_are_bound():
    b = validation.bind_columns(["customer_id", "status", "part_a", "part_b", "total", "application_date", "joining_date", "end_date"],
                                {"customer_id": "UID", "application_date": "DATE", "joining_date": "DATE", "end_date": "DATE"})
    assert b["total"] == "total" and b["parts"] == ["part_a", "part_b"] and (b["key"], b["key_status"]) == ("customer_id", "status")
    assert b["dates"] == ["application_date", "joining_date", "end_date"]
    assert "parts" not in validation.bind_columns(["total", "qty"], {})
