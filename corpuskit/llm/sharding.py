"""Shards of near equal bytes by sampled splitters.

Rows stand in the order of a hash of their text, so equal texts are neighbours.
Size-weighted samples of that order give the boundaries of many small ranges;
ranges that come out too full get boundaries of their own, inside a group of
equal texts as well, until none is.  Only the sizes of the ranges reach the
driver, which deals them to the shards, the largest first into the emptiest.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.rows import ROW, kept_table, unpacked, whole_text

# Ranges that a shard is made of, and samples drawn for each boundary.
RANGES = 64
SAMPLES = 16
# A range is too full above this many times its share of the bytes, or of the rows.
OVERFULL = 2.0
# Equal texts stay in one shard while they are at most this share of one.
WHOLE_GROUP = 0.25


class Splitters:
    """Sorted boundaries in the order (group, row); a range starts at its boundary."""

    def __init__(self, groups: np.ndarray, rows: np.ndarray) -> None:
        pairs = np.unique(np.stack([groups, rows], axis=1).astype(np.int64), axis=0)
        self.groups, self.rows = pairs[:, 0], pairs[:, 1]

    def __len__(self) -> int:
        return len(self.groups)

    def place(self, groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many boundaries are at or before each key: the number of its range."""
        first = np.searchsorted(self.groups, groups, "left")
        last = np.searchsorted(self.groups, groups, "right")
        out = first.copy()
        # Boundaries with the row's own group are few; they are compared by row.
        for low, high in {*zip(first[first < last].tolist(), last[first < last].tolist())}:
            own = (first == low) & (last == high)
            out[own] = low + np.searchsorted(self.rows[low:high], rows[own], "right")
        return out

    def with_more(self, groups: np.ndarray, rows: np.ndarray) -> Splitters:
        return Splitters(np.r_[self.groups, groups], np.r_[self.rows, rows])


def range_number(splitters: Splitters) -> Column:
    @F.pandas_udf("int")
    def number(groups: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series(splitters.place(groups.to_numpy(), rows.to_numpy()), dtype="int32")

    return number("group", "uid")


def _luck(turn: int) -> Column:
    """A number from 0 to 1 for each row, the same in every run."""
    return F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(2 ** 40)) / F.lit(float(2 ** 40))


def splitters(keys: DataFrame, ranges: int) -> Splitters:
    """Boundaries between which no range has over ``OVERFULL`` times its share of bytes or rows, single rows apart.

    The first samples give quantiles; each later round looks into the ranges that
    are too full alone and cuts them before and behind the groups it draws, and
    where a range is a single group, between its rows.  What a round draws is
    about ``SAMPLES`` rows for each range it cuts.
    """
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not rows:
        return Splitters(np.empty(0), np.empty(0))
    most_bytes, most_rows = OVERFULL * total / ranges, OVERFULL * max(1.0, rows / ranges)
    # A row's chance to be drawn is in proportion to its size.
    drawn = keys.filter(_luck(0) < F.col("size") * (SAMPLES * ranges / total)).select("group").toPandas()
    quantiles = np.sort(drawn["group"].to_numpy())[SAMPLES - 1::SAMPLES]
    found = Splitters(quantiles, np.full(len(quantiles), -1))
    turn = 0
    while True:
        turn += 1
        numbered = keys.withColumn("range", range_number(found))
        full = numbered.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n"),
            (F.min("group") == F.max("group")).alias("one_group")).filter(
            (F.col("n") > 1) & ((F.col("bytes") > most_bytes) | (F.col("n") > most_rows))).toPandas()
        if full.empty:
            return found
        # A range is cut in as many parts as its bytes or its rows ask for.
        parts = np.ceil(np.maximum(full["bytes"] / most_bytes, full["n"] / most_rows) * 2)
        by_bytes = dict(zip(full["range"].tolist(), (parts * SAMPLES / full["bytes"]).tolist()))
        by_rows = dict(zip(full["range"].tolist(), (parts * SAMPLES / full["n"]).tolist()))
        single = dict(zip(full["range"].tolist(), full["one_group"].tolist()))
        asked = dict(zip(full["range"].tolist(), parts.astype(int).tolist()))

        @F.pandas_udf("double")
        def chance(number: pd.Series, size: pd.Series) -> pd.Series:
            return np.maximum(number.map(by_bytes).fillna(0.0) * size, number.map(by_rows).fillna(0.0))

        some = numbered.filter(_luck(turn) < chance("range", "size")).select("range", "group", "uid").toPandas()
        some = some.sort_values(["group", "uid"])
        groups, cuts = [], []
        for number, own in some.groupby("range"):
            chosen = own.iloc[(np.arange(asked[number]) + 0.5) * len(own) // asked[number]]
            # A draw may be where the range starts already, so the cuts are before and behind it.
            if single[number]:
                groups += [*chosen["group"], *chosen["group"]]
                cuts += [*chosen["uid"], *(chosen["uid"] + 1)]
            else:
                chosen = np.unique(chosen["group"])
                groups += [*chosen, *(chosen + 1)]
                cuts += [-1] * (2 * len(chosen))
        found = found.with_more(np.array(groups, np.int64), np.array(cuts, np.int64))


def deal(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit: the largest first, into the shard with the fewest bytes."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        filled, shard = heapq.heappop(heap)
        out[at] = shard
        heapq.heappush(heap, (filled + sizes[at], shard))
    return out


def _placed(keys: DataFrame, shards: int) -> DataFrame:
    """``uid`` with ``size``, ``shard`` and ``slot``."""
    spark = keys.sparkSession
    cut = splitters(keys, shards * RANGES)
    numbered = kept_table(keys.withColumn("range", range_number(cut)), "ranges")
    found = numbered.groupBy("range").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("group").alias("first"),
        F.max("group").alias("last")).toPandas().sort_values("range", ignore_index=True)
    # Ranges that hold parts of one group go together unless the group is too large a part of a shard.
    single = (found["first"] == found["last"]) & (
        found["bytes"].groupby(found["first"]).transform("sum") <= WHOLE_GROUP * found["bytes"].sum() / shards)
    apart = ~(single & single.shift(fill_value=False) & (found["first"] == found["first"].shift()))
    unit = apart.cumsum() - 1
    found["shard"] = np.array(deal(found["bytes"].groupby(unit).sum().tolist(), shards), np.int32)[unit]
    found["base"] = found.groupby("shard")["n"].cumsum() - found["n"]
    table = spark.createDataFrame(found[["range", "shard", "base"]], "range int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("group", "uid")) - 1
    # As many rows as there are ranges: some thousands, whatever the input.
    return numbered.withColumn("_place", place).join(F.broadcast(table), "range").select(
        "uid", "size", "shard", (F.col("base") + F.col("_place")).alias("slot"))


def _keyed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    return docs.select(
        *more, F.xxhash64(whole_text(text)).bitwiseAND(F.lit(2 ** 63 - 2)).alias("group"),
        F.monotonically_increasing_id().alias("uid"),
        (F.octet_length(whole_text(text)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(whole_text(text), "UTF-8")).alias("text_crc32"))


def shard_places(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``size``, ``text_crc32``, ``shard``, ``slot``) of every row; texts do not move.

    ``size`` is the text's UTF-8 bytes and one more; the shards' sums are near
    equal, as far as single rows allow.  ``slot`` counts a shard's rows from 0
    without gaps.  Rows with equal texts stand in one shard, side by side, while
    they are at most ``WHOLE_GROUP`` of a shard together; larger groups are dealt
    out.  A null text counts as empty, a null key is kept, repeated rows are rows
    of their own, and an empty table gives an empty result.  Other columns are
    not looked at.
    """
    keys = kept_table(_keyed(docs, text, F.col(key).alias("key")), "keys")
    placed = _placed(keys.select("group", "uid", "size"), shards)
    return keys.select("key", "uid", "size", "text_crc32").join(placed.drop("size"), "uid").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> None:
    """All rows with their own columns as Parquet below ``path``, one folder ``shard=k`` for each shard, by slot.

    The caller's columns ``size``, ``shard`` and ``slot`` give way to new ones.
    Files of a shard are ranges of its slots, about 128 MB of text each.
    """
    rows = kept_table(_keyed(docs, text, F.struct("*").alias(ROW)), "rows")
    placed = _placed(rows.select("group", "uid", "size"), shards)
    placed = kept_table(placed, "placed")
    total, n = placed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    # Slots of one file, from the mean size of a row.
    step = max(1, int(128 * 2 ** 20 * n / max(total, 1)))
    out = rows.select("uid", ROW).join(placed, "uid").withColumn("_file", F.floor(F.col("slot") / step))
    out = out.repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    unpacked(out, docs, "size", "shard", "slot").write.partitionBy("shard").parquet(path)
