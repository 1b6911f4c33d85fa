"""Numbers written as text, and the parts in which a table is cleaned."""
import glob

from pyspark.sql import functions as F

from tidymill.functions.numbers import parse_number
from tidymill.functions.text import NUMERIC, number
from tidymill.plans.full_clean import clean_table
from tidymill.plans.quantiles import exact_quantiles

ODD = ["", " ", "1", " 1 ", "\t-2.5\n", "+.5", "5.", ".", "-", "+", "e5", "1e5", "1E-5", "1e", "1e+", "1d", "2.5F", "1L", "NaN", "nan", "-nan", "+NaN", "Infinity", "-infinity", "inf", "+Inf", "infin", "0x1p3", "0x1.8P-2", "0x", "0x.p1",
       "0x1.p1", "0x10", "1_000", "1,5", "1.2.3", "--1", "+-1", "١٢", " 1", "1 ", "\x001", "1\x7f", "fifty", "2024-01-01", "user@mail.org", "1 2", "9" * 400, "1e999", "ee", None, "1dd", "1f ", "d", "1\n\n", "İnf", "ınf", "0X1P3D"]


def test_number_is_the_cast(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for text, got, want, cast in df.select("t", number(F.col("t")), F.col("t").try_cast("double"), F.coalesce(F.col("t").rlike(NUMERIC), F.lit(False))).collect():
        assert repr(got) == repr(want), text
        assert cast or want is None, text
        assert not (cast and text in ("", " ", "-", "e5", "1_000", "fifty", "2024-01-01", "user@mail.org", "ee")), f"cast without need: {text!r}"


def test_small_file_is_cleaned_in_parts(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS _rid", "concat('user', id, '@mail.org') AS email").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    done = clean_table(spark.read.parquet(str(tmp_path / "in")), "2024-01-01", workdir=str(tmp_path / "work"))
    assert done.table.count() == 1000
    assert len(glob.glob(str(tmp_path / "work/raw/*.parquet"))) == spark.sparkContext.defaultParallelism


def test_bare_numbers_are_parsed_as_all_others(spark):
    texts = {"5": 5.0, " -7.25 ": -7.25, "+3.": 3.0, "007": 7.0, "1" * 400: float("inf"), "$1,234.50": 1234.5, "1.234,50 EUR": 1234.5, "12 %": 12.0, "5\n": 5.0, "": None, "-": None, "x": None, "1.2.3": None}
    got = {r["t"]: r["x"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_number(F.col("t")).alias("x")).collect()}
    assert got == texts


def test_quantile_scans_work_the_values_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).select(F.col("id").cast("double").alias("x")).mapInArrow(counted, "x double")
    assert exact_quantiles(df, F.col("x"), [0.25, 0.5]) == [249.75, 499.5]
    assert seen.value == 1000
