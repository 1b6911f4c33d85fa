"""Suites and sampled charts have no SQL of their own: they are held against the single operators, which have, and against plain Python."""
import json

import pytest
from pyspark.sql import functions as F

from tidymill.operators import analytics as an
from tidymill.operators import charts as ch
from tidymill.plans import profile as pf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet").withColumn("_rid", F.col("o_orderkey")).persist()


def lines(df):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect())


def test_suite_frames_are_those_of_the_operators(orders):
    found = an.suite(orders, "o_orderdate", ["o_totalprice"], ["o_orderpriority"], "o_custkey")
    monthly = an.time_series(orders, "o_orderdate", "o_totalprice", "month")
    want = {"o_totalprice.percentiles": an.percentiles(orders, ["o_totalprice"]), "o_totalprice.distribution": an.distribution(orders, "o_totalprice"),
            "o_totalprice.concentration": an.concentration(orders, "o_totalprice"), "o_totalprice.mom": an.period_change(orders, "o_orderdate", "o_totalprice", "month"),
            "o_totalprice.qoq": an.period_change(orders, "o_orderdate", "o_totalprice", "quarter"), "o_totalprice.yoy": an.period_change(orders, "o_orderdate", "o_totalprice", "year"),
            "o_totalprice.trend": an.trend(monthly), "o_totalprice.seasonality": an.seasonality(monthly), "o_totalprice.outlier_periods": an.outlier_periods(monthly),
            "o_totalprice.forecast": an.forecast_linear(monthly), "o_totalprice.statistics": an.series_statistics(monthly), "o_totalprice.pareto.o_orderpriority": an.pareto(orders, "o_orderpriority", "o_totalprice"),
            "o_orderpriority.frequency": an.frequency(orders, "o_orderpriority"), "cohorts": an.cohorts(orders, "o_orderdate", "o_custkey"), "retention": an.cohort_retention(orders, "o_orderdate", "o_custkey")}
    assert set(found) == set(want)
    for name in ("o_totalprice.percentiles", "o_totalprice.mom", "o_totalprice.trend", "o_orderpriority.frequency", "cohorts"):
        assert lines(found[name]) == lines(want[name]), name


def test_scatter_is_a_fixed_sample_of_the_pairs(orders):
    df = orders.select("_rid", "o_totalprice", F.when(F.col("_rid") % 5 > 0, F.col("o_custkey")).alias("customer"))
    pairs = {r._rid: (round(r.o_totalprice, 4), float(r.customer)) for r in df.collect() if r.customer is not None}
    found = [tuple(r) for r in ch.scatter(df, "o_totalprice", "customer").collect()]
    assert len(found) == 400 and len({i for i, _, _ in found}) == 400
    assert all(pairs[i] == (x, y) for i, x, y in found)
    assert sorted(found) == sorted(tuple(r) for r in ch.scatter(df.repartition(7), "o_totalprice", "customer").collect())
    few = df.filter("_rid % 50 = 1")
    assert {r._rid: (r.x, r.y) for r in ch.scatter(few, "o_totalprice", "customer").collect()} == {i: p for i, p in pairs.items() if i % 50 == 1}


def test_suite_of_charts(spark, orders):
    roles = spark.createDataFrame([("o_orderdate", "date", 900), ("o_totalprice", "metric", 1500), ("o_shippriority", "metric", 1), ("o_orderpriority", "category", 5), ("o_clerk", "code", 12), ("o_comment", "text", 1400)],
                                  "column string, role string, distinct_count long")
    have = [c for c in ("o_totalprice", "o_orderpriority", "o_orderdate") if c in orders.columns]
    roles = roles.filter(F.col("column").isin(*have))
    specs = ch.suite_specs(roles)
    assert specs == [("line", "o_orderdate", "o_totalprice"), ("bar", "o_orderpriority", "o_totalprice"), ("distribution", "o_orderpriority", None)]
    points = ch.suite(orders, roles)
    assert list(points) == specs
    assert lines(points[specs[1]]) == lines(ch.ranked_bar(orders, "o_orderpriority", "o_totalprice", k=None))
    assert lines(points[specs[2]]) == lines(ch.distribution(orders, "o_orderpriority"))
    assert lines(points[specs[0]]) == lines(ch.time_series(orders, "o_orderdate", "o_totalprice", "mean"))
    many = spark.createDataFrame([(f"m{i}", "metric", 9) for i in range(9)], "column string, role string, distinct_count long")
    assert len(ch.suite_specs(many)) == 15 and len(set(ch.suite_specs(many))) == 15


def test_distribution_of_more_rows_than_a_cube_of_counts_holds(spark):
    """Three counts multiplied overflow a long from 2 097 152 rows on; 0 to 4 in equal parts have closed forms."""
    n = 2_500_000
    row = an.distribution(spark.range(n).select((F.col("id") % 5).cast("double").alias("x")), "x").first()
    assert (row["n"], row["mean"], row["median"], row["mode"], row["skewness"]) == (n, 2.0, 2.0, 0.0, 0.0)
    assert row["kurtosis"] == -1.3


def test_suite_holds_a_table_of_more_rows_than_a_cube_of_counts_holds(spark):
    many = spark.range(2_500_000).select((F.col("id") % 4).cast("double").alias("x"), F.lit("a").alias("c"))
    found = {name: df.collect() for name, df in an.suite(many, value_cols=["x"], category_cols=["c"]).items()}
    assert found["x.distribution"][0]["kurtosis"] == -1.36 and found["c.frequency"][0]["n"] == 2_500_000


def test_column_statistics_sort_no_cells(spark, monkeypatch):
    """Texts in the buffers of an aggregate by key make Spark sort all unpivoted cells of a task, unless the buffers are objects. Passes of few columns give the same."""
    df = spark.range(3000).selectExpr("id AS _rid", *[f"CASE WHEN id % 3 = 0 THEN NULL ELSE ' v' || id % {k + 1} END AS c{k}" for k in range(7)])
    plans, agg = [], type(df).collect

    def collect(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return agg(frame)

    monkeypatch.setattr(type(df), "collect", collect)
    whole = pf.column_statistics(df, samples=2)
    monkeypatch.setattr(pf, "PER_PASS", 3)
    assert pf.column_statistics(df, samples=2) == whole and len(plans) == 4
    assert all("ObjectHashAggregate" in p and "Sort" not in p for p in plans)
    assert [whole[f"c{k}"]["distinct"] for k in range(7)] == [1, 2, 2, 4, 5, 4, 7]
    assert all(s["rows"] == 3000 and s["filled"] == 2000 and s["s0"]["value"].startswith(" v") for s in whole.values())
