"""Ordered computations over groups of unbounded size.

A plain window puts a whole group into one task.  Here a group is cut into
blocks of consecutive positions, the window runs per (group, block), and only
one summary row per block crosses block borders.  Blocks come from the data
(``floor(position / width)`` or a caller's expression), so a recomputed task
cuts in the same places, and a group holding a third of all rows spreads over
as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import kept_table

BLOCK_WIDTH = 1 << 16


def _order(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _blocked(df: DataFrame, order: list[str], block: Column | None) -> DataFrame:
    cut = F.floor(F.col(order[0]) / BLOCK_WIDTH) if block is None else block
    return df.withColumn("_block", cut.cast("long"))


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: Column,
    out: str,
    descending: bool = False,
    block: Column | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including the row, per group.

    ``order`` starts with a numeric position; the whole tuple must be unique
    within a group.  ``block`` must not decrease along the order.
    """
    names, keys = _order(order), list(keys)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    blocked = _blocked(df, names, block).withColumn("_value", value)

    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*[direction(c) for c in names])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = (
        Window.partitionBy(*keys)
        .orderBy(direction("_block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (group, block); groups with a single block need no carry.
    carry = (
        blocked.groupBy(*keys, "_block")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_carry", F.sum("_total").over(across))
        .filter(F.col("_carry").isNotNull())
        .select(*keys, "_block", "_carry")
    )
    return (
        blocked.withColumn("_running", F.sum("_value").over(inside))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.col("_running") + F.coalesce(F.col("_carry"), F.lit(0)))
        .select(*df.columns, out)
    )


def row_position(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    out: str,
    descending: bool = False,
    block: Column | None = None,
) -> DataFrame:
    """Add ``out``: the 1-based position of the row within its group."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, descending, block)


def earlier_values(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], value: str, out: str, block: Column | None = None,
) -> DataFrame:
    """Add ``out``: the values of all earlier rows of the group, in their order.

    Every block collects its own; what the blocks ahead hold is one list per
    block, carried as it is.
    """
    names, keys = _order(order), list(keys)
    blocked = _blocked(df, names, block)
    inside = (
        Window.partitionBy(*keys, "_block").orderBy(*names)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    lists = blocked.groupBy(*keys, "_block").agg(
        F.array_sort(F.collect_list(F.struct(*names, F.col(value).alias("_value")))).alias("_rows"))
    carry = (
        lists.withColumn("_rows", F.transform("_rows", lambda r: r["_value"]))
        .withColumn("_carry", F.flatten(F.collect_list("_rows").over(across)))
        .filter(F.size("_carry") > 0).select(*keys, "_block", "_carry")
    )
    none = F.array().cast(f"array<{df.schema[value].dataType.simpleString()}>")
    return (
        blocked.withColumn("_own", F.collect_list(value).over(inside))
        .join(carry, [*keys, "_block"], "left")
        .withColumn(out, F.concat(F.coalesce("_carry", none), "_own"))
        .select(*df.columns, out)
    )


def ordered_text(
    df: DataFrame, keys: Sequence[str], position: str, piece: str, separator: str, out: str,
    sums: dict[str, Column] | None = None, width: int = 1000,
) -> DataFrame:
    """keys, ``out``, sums: the pieces of a group joined by position.

    ``width`` positions are joined at a time, each lot in a task of its own, and
    then the lots; what a group's task sees is one text per lot.
    """
    keys, sums = list(keys), sums or {}

    def joined(rows: DataFrame, by: list[str], at: str, text: str, extra: list[Column]) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("text"))))
        return rows.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), separator).alias(out), *extra)

    lots = joined(
        df.withColumn("_lot", F.floor(F.col(position) / width)), [*keys, "_lot"], position, piece,
        [F.sum(c).alias(name) for name, c in sums.items()])
    return joined(lots, keys, "_lot", out, [F.sum(name).alias(name) for name in sums])


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    columns: Sequence[str],
    out: str,
    step: int = 1,
    block: Column | None = None,
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` from the next (+1) or previous (-1) row.

    Null at the end of a group.
    """
    if step not in (1, -1):
        raise ValueError("step is +1 (next) or -1 (previous)")
    names, keys = _order(order), list(keys)
    blocked = _blocked(df, names, block).withColumn("_row", F.struct(*columns))
    inside = Window.partitionBy(*keys, "_block").orderBy(*names)
    across = Window.partitionBy(*keys).orderBy("_block")
    rank = F.struct(*names)
    edge = (F.min_by if step == 1 else F.max_by)("_row", rank)
    shift = F.lead if step == 1 else F.lag
    borders = (
        blocked.groupBy(*keys, "_block")
        .agg(edge.alias("_edge"))
        .withColumn("_border", shift("_edge").over(across))
        .filter(F.col("_border").isNotNull())
        .select(*keys, "_block", "_border")
    )
    return (
        blocked.withColumn("_near", shift("_row").over(inside))
        .join(borders, [*keys, "_block"], "left")
        .withColumn(out, F.coalesce("_near", "_border"))
        .select(*df.columns, out)
    )


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank"
) -> DataFrame:
    """The first ``n`` rows per group with their rank.

    Spark keeps only ``n`` rows per group in every map task before the shuffle
    (a window group limit), so a hot group reaches its task already cut down.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)


def rank_select(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], bins: int = 200
) -> DataFrame:
    """Exact order statistics per group without sorting a group in one task.

    ``ranks`` maps an output name to a zero-based rank written over the column
    ``n`` (rows in the group).  Equal values are counted first, map-side; the
    distinct values are then cut at their own approximate quantiles, so bins are
    about equally full however the values lie, and running counts over (group,
    bin) locate each rank.  Approximate quantiles depend on the order in which
    rows arrive, so the cuts are stored: every reader of them has the same bins.
    Nulls in ``keys`` are a group.
    """
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
        return rank_select(df, keys, value, ranks, bins).drop("_all")
    keys = list(keys)
    # One struct, because structs with nulls inside are equal in a join.
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.struct(*keys).alias("_group"), F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    spans = kept_table(counts.groupBy("_group").agg(
        F.percentile_approx("_v", [i / bins for i in range(1, bins)], 10 * bins).alias("_cuts"),
        F.sum("_c").alias("n"),
    ), "cuts")
    binned = counts.join(spans, "_group")
    running = running_total(
        binned, ["_group"], "_v", F.col("_c"), "_upto",
        block=F.size(F.filter("_cuts", lambda cut: cut < F.col("_v"))),
    )
    picks = [
        F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")), F.col("_v")))
        .alias(name)
        for name, r in ranks.items()
    ]
    return running.groupBy("_group").agg(F.max("n").alias("n"), *picks).select("_group.*", "n", *ranks)
