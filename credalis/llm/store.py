"""Shared-folder tables: how jobs cut lineage so that they survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; where that is unset, the warehouse, or in local mode a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] == "local":
        at = _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="credalis-"))
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with the same schema. It goes by ``dropped``, at the latest
    when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._credalis_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes tables of ``saved`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_credalis_path", None):
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shielded(docs: DataFrame, own: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f(docs)`` with all columns but ``own`` under names of no meaning meanwhile, so that none clashes with a working column."""
    plain = [c if c in own else f"_x{i}" for i, c in enumerate(docs.columns)]
    back = dict(zip(plain, docs.columns, strict=True))
    out = f(docs.toDF(*plain))
    return out.toDF(*[back.get(c, c) for c in out.columns])
