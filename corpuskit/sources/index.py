"""The vector table on disk: Parquet, one partition value per collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _laid_out(df: DataFrame) -> DataFrame:
    """Rows of a collection side by side; AQE splits a collection that is too big
    for one task and merges small ones."""
    return df.hint("rebalance", "collection")


def write_index(df: DataFrame, path: str, mode: str = "append") -> None:
    _laid_out(df).write.mode(mode).partitionBy("collection").parquet(path)


def replace_partitions(df: DataFrame, path: str) -> None:
    """Overwrite only the collections present in ``df``."""
    (
        _laid_out(df).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("collection").parquet(path)
    )


def read_index(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """The whole table, or one collection (partition pruning)."""
    df = spark.read.parquet(path)
    return df if collection is None else df.filter(F.col("collection") == collection)


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether the table's folder is there, asked of the file system it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
