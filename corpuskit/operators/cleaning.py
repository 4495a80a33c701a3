"""Text cleaning steps as DataFrame transforms, and their default order."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.functions.settle import settle

MIN_BLOCK = 80  # fixed value: shorter blocks do not vote on headers and footers


def drop_repeated_headers_footers(
    df: DataFrame, column: str = "text", min_block: int = MIN_BLOCK, keep_short: bool = True
) -> DataFrame:
    """Remove first (last) lines shared by two or more page blocks of a text.

    Only blocks of at least ``min_block`` characters and more than two lines
    vote.  Short blocks pass through unchanged with ``keep_short`` (default);
    ``keep_short=False`` deletes them whenever something was removed.
    """
    names = df.columns
    lines = F.transform(tx.split_blocks(F.col(column)), lambda b: F.struct(
        tx.lines(b).alias("rows"), F.length(b).alias("n")))
    df = df.withColumn("_blocks", F.transform(lines, lambda b: F.struct(
        b["rows"].alias("rows"), F.transform(b["rows"], tx.strip).alias("bare"),
        ((b["n"] >= min_block) & (F.size(b["rows"]) > 2)).alias("votes"))))
    voting = F.filter("_blocks", lambda b: b["votes"])
    df = df.withColumn("_voting", F.transform(voting, lambda b: b["bare"]))
    df = df.withColumn("_headers", tx.repeated(F.transform("_voting", lambda r: F.element_at(r, 1))))
    df = df.withColumn("_footers", tx.repeated(F.transform("_voting", lambda r: F.element_at(r, -1))))

    def first_kept(bare: Column, listed: str) -> Column:
        return F.array_min(F.array_compact(F.transform(
            bare, lambda r, i: F.when(~F.array_contains(listed, r), i + 1))))

    def last_kept(bare: Column, listed: str) -> Column:
        return F.array_max(F.array_compact(F.transform(
            bare, lambda r, i: F.when(~F.array_contains(listed, r), i + 1))))

    bounds = F.transform("_blocks", lambda b: F.struct(
        b["rows"].alias("rows"), b["votes"].alias("votes"),
        first_kept(b["bare"], "_headers").alias("first"), last_kept(b["bare"], "_footers").alias("last")))
    short = (lambda b: F.array_join(b["rows"], "\n")) if keep_short else (lambda b: F.lit(None).cast("string"))
    kept = F.transform(bounds, lambda b: F.when(~b["votes"], short(b)).when(
        b["first"] <= b["last"],
        F.array_join(F.slice(b["rows"], b["first"], b["last"] - b["first"] + 1), "\n")))
    fires = (F.size("_headers") > 0) | (F.size("_footers") > 0)
    out = F.when(fires, F.array_join(F.array_compact(kept), "\n\n")).otherwise(F.col(column))
    return df.withColumn(column, out).select(*names)


def drop_page_lines(
    df: DataFrame, column: str = "text", numbers: bool = True, markers: bool = True
) -> DataFrame:
    """Drop number-only lines that have no number line directly above or below
    (those look like table data), and ``Page 3 of 10`` lines.

    Neighbours are taken from the original lines, as shifted arrays: no shuffle,
    and every array is computed once per document.
    """
    names = df.columns
    df = df.withColumn("_lines", tx.lines(F.col(column)))
    df = df.withColumn("_number", F.transform("_lines", tx.is_number_line))
    edge = F.array(F.lit(False))
    rest = F.greatest(F.size("_number") - 1, F.lit(0))
    above = F.concat(edge, F.slice("_number", 1, rest))
    below = F.concat(F.slice("_number", 2, rest), edge)
    df = df.withColumn("_rows", F.arrays_zip(
        F.col("_lines").alias("line"), F.col("_number").alias("number"),
        F.zip_with(above, below, lambda a, b: a | b).alias("beside")))

    def keep(r: Column) -> Column:
        kept = F.lit(True)
        if numbers:
            kept = kept & (~r["number"] | r["beside"])
        if markers:
            kept = kept & ~tx.is_page_marker(r["line"])
        return kept

    rows = F.transform(F.filter(F.filter("_rows", lambda r: r["line"].isNotNull()), keep), lambda r: r["line"])
    return df.withColumn(column, F.array_join(rows, "\n")).select(*names)


def page_artifacts(df: DataFrame, column: str) -> DataFrame:
    """Page lines, then repeated headers and footers, then leftover blank lines."""
    df = drop_page_lines(df, column)
    df = drop_repeated_headers_footers(df, column)
    return df.withColumn(column, tx.collapse_blank_lines(F.col(column)))


STEPS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "whitespace": lambda df, c: df.withColumn(c, tx.clean_whitespace(F.col(c))),
    "unicode": lambda df, c: df.withColumn(c, tx.clean_unicode(F.col(c))),
    "page_artifacts": page_artifacts,
}
DEFAULT_ORDER = ("whitespace", "unicode", "page_artifacts")


def clean(
    df: DataFrame, steps: Sequence[str] = DEFAULT_ORDER, source: str = "text", out: str = "clean_text"
) -> DataFrame:
    """Run the named steps in order, into column ``out``."""
    df = df.withColumn(out, F.col(source))
    for step in steps:
        df = settle(STEPS[step](df, out), out)
    return df
