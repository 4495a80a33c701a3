"""Keeping a caller's columns apart from an operator's own."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import fresh_path

ROW = "_row"


_WRITTEN = threading.local()


def _written() -> list[str]:
    """Paths of the tables that this thread has kept and not removed, oldest first."""
    if not hasattr(_WRITTEN, "paths"):
        _WRITTEN.paths = []
    return _WRITTEN.paths


def kept_table(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, read again: computed once, whatever is lost."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    _written().append(path)
    return df.sparkSession.read.parquet(path)


def kept_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` returns, as a table; the tables it kept on the way are removed when that one is written."""
    first = len(_written())
    out = kept_table(make(), label)
    for path in _written()[first:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written()[first:-1]
    return out


# Rows of a few numbers that are broadcast at most: some tens of MB.
BROADCAST_ROWS = 500_000


def counted_hint(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Ask for a broadcast of narrow rows if there are at most ``most``; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, size: str = "16m") -> None:
    """Bound the Arrow batches that reach Python by bytes: a batch of very long texts must fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """The input row as one struct, and the named columns beside it.

    An operator's working names therefore never clash with a caller's columns.
    """
    return docs.select(F.struct("*").alias(ROW), *[c.alias(k) for k, c in named.items()])


def unpacked(df: DataFrame, source: DataFrame, *new: str, replace: dict[str, str] | None = None) -> DataFrame:
    """The caller's columns again, then ``new``.

    A caller's column that has the name of a new one gives way to it.
    ``replace`` maps a caller's column to the column that takes its place.
    """
    replace = replace or {}
    old = [
        (F.col(replace[c]) if c in replace else F.col(f"{ROW}.`{c}`")).alias(c)
        for c in source.columns if c not in new]
    return df.select(*old, *[F.col(c) for c in new])


def whole_text(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
