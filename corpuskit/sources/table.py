"""A stored vector table that takes writes without moving what it holds.

Rows lie in ``parts`` folders by a hash of (collection, chunk_id), and within a
folder in buckets of the same key.  A join on the key therefore reads the table
where it lies; only the new rows are shuffled to its buckets.  Inserts add files;
updates and deletes rewrite the folders that they touch, and no others.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.operators.collections import KEY, _one_per_key
from corpuskit.session import kept_table
from corpuskit.sources.index import index_exists

PART = "part"


@dataclass
class StoredTable:
    """The table at ``path``.  ``parts`` and ``buckets`` are fixed when it is created.

    One writer at a time.  A write that was broken off leaves folders either as
    they were or rewritten whole; a repeated insert, update or delete then ends
    in the same table.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: int = 32
    buckets: int = 8

    def __post_init__(self) -> None:
        """Name the folder in this session's catalogue, which needs no more than its layout."""
        self.name = "stored_" + hashlib.md5(self.path.encode()).hexdigest()
        if not self.spark.catalog.tableExists(self.name):
            if not index_exists(self.spark, self.path):
                self._files()[0].mkdirs(self._files()[1])
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
            keys = ", ".join(KEY)
            self.spark.sql(
                f"CREATE TABLE {self.name} ({fields}, {PART} INT) USING parquet PARTITIONED BY ({PART}) "
                f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self._fresh()

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _fresh(self) -> None:
        """Let the catalogue see the folders that are there now, at most ``parts``."""
        self.spark.sql(f"MSCK REPAIR TABLE {self.name} SYNC PARTITIONS")
        self.spark.sql(f"REFRESH TABLE {self.name}")

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(self.parts)).cast("int").alias(PART)

    def read(self) -> DataFrame:
        return self._rows().drop(PART)

    def _rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _touched(self, keys: DataFrame) -> list[int]:
        """At most ``parts`` numbers."""
        return sorted(r[0] for r in keys.select(self._part()).distinct().collect())

    def _write(self, rows: DataFrame, replace: bool) -> None:
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self._part())
        # In buckets already where they come from a join with the table.
        mode = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            named.write.insertInto(self.name, overwrite=replace)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
        self._fresh()

    def fresh_rows(self, new: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Of ``new`` the rows whose key the table lacks, one for each key (the first by ``order``)."""
        one = _one_per_key(new, order)
        known = self._rows().filter(F.col(PART).isin(self._touched(new))).select(*KEY)
        # Hinted, so that a small table is not broadcast from its buckets by mistake.
        return one.join(known.hint("shuffle_hash"), KEY, "left_anti")

    def insert_ignore(self, new: DataFrame, order: list[str] | None = None) -> int:
        """Add the rows with new keys as files of their own; the number added."""
        fresh = kept_table(self.fresh_rows(new, order), "fresh")
        self._write(fresh, replace=False)
        return fresh.count()

    def merged(self, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
        """The touched folders' rows with the changes in them."""
        fields = [c for c in changes.columns if c not in KEY]
        renamed = _one_per_key(changes, order).select(*KEY, *[F.col(c).alias(f"_new_{c}") for c in fields])
        rows = self._rows().filter(F.col(PART).isin(self._touched(changes)))
        return rows.hint("merge").join(renamed, KEY, "left").select(*[
            F.coalesce(f"_new_{f.name}", f.name).alias(f.name) if f.name in fields else F.col(f.name)
            for f in self.schema])

    def update_by_id(self, changes: DataFrame, order: list[str] | None = None) -> None:
        """Replace the columns in ``changes`` on existing rows; unknown keys are left out, nulls change nothing."""
        self._write(self.merged(changes, order), replace=True)

    def remaining(self, ids: DataFrame) -> DataFrame:
        rows = self._rows().filter(F.col(PART).isin(self._touched(ids)))
        return rows.hint("merge").join(ids.select(*KEY), KEY, "left_anti").drop(PART)

    def delete_by_id(self, ids: DataFrame) -> None:
        """Drop the rows with these keys; unknown ones are passed over."""
        touched, rest = self._touched(ids), kept_table(self.remaining(ids), "rest")
        left = self._touched(rest)
        if left:
            self._write(rest, replace=True)
        # A folder that loses its last row is not among those rewritten.
        files, where = self._files()
        for part in set(touched) - set(left):
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{PART}={part}"), True)
        self._fresh()
