"""Helpers of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.session import ship_package


class Book:
    """Collects queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, as_is: tuple[str, ...] = ()):
        """Register a query; columns in ``as_is`` keep their type and all their digits."""
        def keep(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_package(spark)
                return plain(fn(Tables(spark, sf_dir)), as_is=as_is)

            run.__name__ = name
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return keep


class Tables:
    """The given tables, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def text(self, name: str) -> DataFrame:
        """A text table, spread over all cores when its files give fewer splits.

        A big table has more splits than cores and is left alone.
        """
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    def corpus(self) -> DataFrame:
        return self.text("documents").select(F.col("doc_id").alias("chunk_id"), "text")

    def text_queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), "text")

    def vector_queries(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("query_id"), "embedding", "label")

    def vector_index(self) -> DataFrame:
        return self.embeddings.select(
            F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("collection"))


def plain(df: DataFrame, digits: int = 6, as_is: tuple[str, ...] = ()) -> DataFrame:
    """Whole numbers as bigint and doubles rounded, as the SQL side has them."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in as_is:
            pass
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            # adding zero turns -0.0 into 0.0
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        out.append(c.alias(field.name))
    return df.select(*out)
