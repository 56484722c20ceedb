"""Tables in the folder that all machines share, by which jobs survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the warehouse, or in local mode a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] == "local":
        at = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="credalis-"))
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table that is read again; it goes when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` with ``_id``: the hash of the column ``key``, or numbers that are written with the rows, so that they stay the same
    when a lost task runs again."""
    if key is not None:
        return df.withColumn("_id", F.xxhash64(F.col(f"`{key}`")))
    return written(df.withColumn("_id", F.monotonically_increasing_id()))
