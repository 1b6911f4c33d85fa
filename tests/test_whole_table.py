from pyspark.sql import functions as F

from tidymill.functions.fixed_values import MOJIBAKE
from tidymill.functions.text import replace_all
from tidymill.operators import whole_table as wt
from tidymill.plans.storage import stored


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _messy(spark):
    made = "_rid bigint, `Full Name` string, `a,b` string, `Group` string"
    return spark.createDataFrame([(0, "ann", "x", "g"), (1, None, None, None), (2, " Grand Total", "y", None), (3, "full name", "a,b", "Group"), (4, "bob", " ", None), (5, "'00cafÃ©", "z", None)], made)


def test_rows_are_cleaned_once_and_kept_and_dropped_read_the_result(spark):
    kept, dropped = wt.rows_to_drop(_messy(spark).withColumn("nothing", F.lit(None)), header=["Full Name", "a,b", "Group"])
    assert [r["_rid"] for r in kept.orderBy("_rid").collect()] == [0, 4, 5]
    assert {(r["_rid"], r["rule"]) for r in dropped.collect()} == {(1, "GLOBAL-05"), (2, "GLOBAL-07"), (3, "GLOBAL-08")}
    for part in (kept, dropped):
        assert "parquet" in _plan(part) and "LogicalRDD" not in _plan(part) and "LocalRelation" not in _plan(part)
    assert kept.columns == ["_rid", "Full Name", "a,b", "Group", "nothing"] and dict(kept.dtypes)["nothing"] == "void"


def test_stored_keeps_names_types_and_rows(spark):
    df = spark.createDataFrame([(1, "x", 2.5, [1])], "`a b` int, `A.b;` string, `A B` double, c array<int>").withColumn("d", F.lit(None))
    back = stored(df, "t")
    assert back.dtypes == df.dtypes and [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]


def test_broken_letters_are_replaced_as_by_plain_replacement(spark):
    texts = ["", None, "plain", "cafÃ©", "â", "Ã", "x\xe2\x80\x99y", "\xc3\x9f", "\xe2\x80\x94Ã¶Ã", "é", "caf\xc3", *[old + "-" + old for old, _ in MOJIBAKE]]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select(wt.without_mojibake(F.col("v")).alias("x"), replace_all(F.col("v"), MOJIBAKE).alias("y")).collect()
    assert all(r["x"] == r["y"] for r in got)


def test_audit_of_the_whole_table(spark):
    lines = {(r["_rid"], r["rule"], r["column"], r["old_value"], r["new_value"]) for r in wt.clean_global(_messy(spark))[2].filter("_rid IS NOT NULL").collect()}
    assert lines == {(1, "GLOBAL-05", None, None, "row dropped"), (2, "GLOBAL-07", None, None, "row dropped"), (3, "GLOBAL-08", None, None, "row dropped"),
                     (4, "GLOBAL-15", "a,b", " ", None), (5, "GLOBAL-11", "Full Name", "'00cafÃ©", "'00café"), (5, "GLOBAL-14", "Full Name", "'00café", "00café")}


def test_the_reason_mentions_every_column_once(spark):
    df = spark.range(1).select(F.col("id").alias("_rid"), F.lower(F.concat(F.lit("a"), F.col("id").cast("string"))).alias("n"), F.upper(F.concat(F.lit("b"), F.col("id").cast("string"))).alias("m"))
    marked = df.filter(wt.drop_reason(["n", "m"], ["n", "m"], ["n", "m"]).isNull())
    pushed = next(line for line in _plan(marked).splitlines() if "Filter" in line)
    assert pushed.count("concat(a") == 1 and pushed.count("concat(b") == 1
