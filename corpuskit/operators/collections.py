"""Maintenance of vector tables: DataFrame in, DataFrame out.

Keys are (collection, chunk_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["collection", "chunk_id"]


def _one_per_key(rows: DataFrame, order: list[str] | None) -> DataFrame:
    """Of rows with equal keys the one that is smallest by ``order``, then by everything else.

    A retry therefore keeps the same row.  Maps have no order and decide nothing.
    """
    kinds = dict(rows.dtypes)
    others = [c for c in rows.columns if c not in KEY and "map<" not in kinds[c]]
    by = F.struct(*dict.fromkeys([*(order or []), *others])) if others or order else F.lit(0)
    kept = rows.groupBy(*KEY).agg(F.min_by(F.struct(*rows.columns), by).alias("_kept"))
    return kept.select("_kept.*")


def insert_ignore(index: DataFrame, new: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Add rows whose key is new; of equal new keys the first by ``order`` is kept."""
    fresh = _one_per_key(new, order).join(index.select(*KEY), KEY, "left_anti")
    return index.unionByName(fresh.select(*index.columns))


def insert_outcome(index: DataFrame, new: DataFrame) -> DataFrame:
    """Offered, inserted and ignored rows per collection; a conflict is no success."""
    known = index.select(*KEY).distinct().withColumn("_known", F.lit(True))
    return (
        new.select(*KEY).distinct().join(known, KEY, "left")
        .groupBy("collection")
        .agg(
            F.count(F.lit(1)).alias("offered"),
            F.count_if(F.col("_known").isNull()).alias("inserted"),
            F.count_if(F.col("_known").isNotNull()).alias("ignored"),
        )
    )


def update_by_id(index: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Replace the columns given in ``changes`` on existing rows; unknown ids are dropped.

    Of several changes to one key the first by ``order`` counts.
    """
    fields = [c for c in changes.columns if c not in KEY]
    renamed = _one_per_key(changes, order).select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in fields])
    merged = index.join(renamed, KEY, "left")
    return merged.select(*[
        F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in index.columns])


def delete_by_id(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select(*KEY), KEY, "left_anti")


def delete_by_filter(index: DataFrame, equals: dict) -> DataFrame:
    """Drop rows that match every equality.

    A null on either side never matches, and without any equality nothing is dropped.
    """
    if not equals:
        return index
    match = F.lit(True)
    for name, value in equals.items():
        match = match & F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    return index.filter(~match)


def collection_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def list_collections(index: DataFrame) -> DataFrame:
    return index.select("collection").distinct()


def collection_exists(index: DataFrame, names: DataFrame) -> DataFrame:
    present = list_collections(index).withColumn("_found", F.lit(True))
    return names.join(present, "collection", "left").select(
        "collection", F.coalesce("_found", F.lit(False)).alias("found"))


def reindex(path: str, new: DataFrame, collection: str) -> None:
    """Replace one collection of a stored table."""
    from corpuskit.sources.index import replace_partitions

    replace_partitions(new.withColumn("collection", F.lit(collection)), path)


LIFTED = ("report_id", "version_id")


def to_index_rows(embedded: DataFrame) -> DataFrame:
    """Lift report and version out of the metadata map; the rest stays as ``extra``.

    Columns of that name, where present, win over the map.
    """
    lifted = []
    for name in LIFTED:
        from_map = F.col("metadata")[name]
        value = F.coalesce(F.col(name), from_map) if name in embedded.columns else from_map
        lifted.append(F.coalesce(value, F.lit("")).alias(name))
    return embedded.select(
        "chunk_id", "embedding", "text", F.size("embedding").alias("dimensions"), *lifted,
        "embedding_model", "embedding_provider",
        F.map_filter("metadata", lambda k, v: ~k.isin(*LIFTED)).alias("extra"))


def indexing_stats(rows: DataFrame, succeeded: Column) -> DataFrame:
    ok = F.coalesce(succeeded, F.lit(False))
    return rows.groupBy("collection").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
    )
