"""The two scalar functions Spark has no expression for: Arrow-batched, and only over distinct values or candidate pairs.

They are built inside functions so that executors receive the code itself and need no copy of this package.
"""
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def match_ratio(a, b):
    """2 * matched characters / total characters, matching the longest common blocks first."""
    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(left, right)], dtype="float64")
    return F.pandas_udf(ratios, DoubleType())(a, b)


def nfkc(v):
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")
    return F.pandas_udf(normal, StringType())(v)
