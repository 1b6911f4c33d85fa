"""Intermediate tables that several passes read."""
import tempfile
import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import NullType


def shared_folder(spark):
    """The folder that spark.checkpoint.dir names; a session in one process may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def stored(df, what):
    """The table, worked out once and read back column by column. Any column names are kept, and columns without a type."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    kept = [f.name for f in plain.schema.fields if not isinstance(f.dataType, NullType)]
    plain.select(*kept).write.parquet(path)
    back = df.sparkSession.read.schema(plain.select(*kept).schema).parquet(path)
    return back.select(*[(F.col(n) if n in kept else F.lit(None)).alias(c) for n, c in zip(plain.columns, df.columns)])
