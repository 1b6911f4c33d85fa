"""Small helpers that the operators of this package share."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and no others. A name is taken by its exact spelling, so further columns may differ from it in case only."""
    places = [df.columns.index(n) for n in names]
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))).select(*(F.col(f"_{i}").alias(n) for i, n in zip(places, names, strict=True)))


def whole_text(column: str = "text") -> Column:
    """A null text counts as the empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict[str, list]] | dict[str, list]], schema: str, rows: int = 256) -> DataFrame:
    """fn gets columns of at most so many rows as Python lists and returns columns; a task holds one such slice at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


_memory: list = [None, None]


def remembered(key, make: Callable):
    """What a worker keeps from batch to batch, under a key. There is one place: a worker that goes on to another operator or model frees it."""
    if _memory[0] != key:
        _memory[:] = [None, None]
        _memory[:] = [key, make()]
    return _memory[1]


def of_text(text: Column, fn: Callable[[list[str]], Iterable[tuple]], schema: str, rows: int = 256) -> Column:
    """A struct column that fn works out from texts alone, so many at a time; the other columns of a row stay in the JVM."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [x for at in range(0, len(texts), rows) for x in fn(texts.iloc[at:at + rows].tolist())]
        return pd.DataFrame(found, columns=names)

    return F.pandas_udf(run, schema).asNondeterministic()(text)     # worked out once, wherever it is used


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: the one spark.checkpoint.dir names. A session in one process may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
