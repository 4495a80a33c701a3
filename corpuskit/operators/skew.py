"""Joins whose big side may hold one key a third of the time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def join_copies(
    rows: DataFrame, unique: DataFrame, keys: list[str], counted: DataFrame, hot_rows: int = HOT_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Join ``rows`` to one row per key, salting the keys with very many rows.

    ``counted`` holds the keys with ``copies``, the number of rows behind each.
    Only keys above ``hot_rows`` are salted, and there are at most
    rows / hot_rows of them, so their list is safe to broadcast.
    """
    salts = F.ceil(F.col("copies") / hot_rows).cast("int")
    hot = counted.filter(F.col("copies") > hot_rows).select(*keys, salts.alias("_salts"))
    hot = F.broadcast(hot)
    others = [c for c in rows.columns if c not in keys] or keys
    left = rows.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*others), F.col("_salts")))
        .otherwise(0).cast("int"),
    ).drop("_salts")
    right = unique.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
