"""Registered queries against their SQL on the smallest tables. Set TIDYMILL_ALL_QUERIES=1 to run every one of them."""
import os

import pytest

import __spark_entry__ as entry
from tools.check import connect, rows_of

SF = "/root/testdata/sf0.001"
FAST = ("an_mom_change", "an_pareto", "an_rank_within_group", "an_moving_average", "clean_email", "clean_amount", "clean_date", "clean_status", "multi_value_explode", "validate_rules", "resolve_missing",
        "dedupe_exact", "duplicates_partial", "forward_fill", "quality_score", "compare_datasets", "chart_grouped", "csv_round_trip", "missing_ranks", "wide_to_long")
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TIDYMILL_ALL_QUERIES") else FAST


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
