"""Document metadata and per-stage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx


def text_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("char_count", F.length(text)).withColumn("word_count", tx.word_count(F.col(text)))


def derive_metadata(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Add ``derived``: title from the path, language, counts."""
    return df.withColumn("derived", F.struct(
        tx.title_from_path(F.col(path)).alias("title"),
        tx.detect_language_en(F.col(text)).alias("language"),
        tx.word_count(F.col(text)).alias("word_count"),
        F.length(text).alias("char_count"),
    ))


# fixed values: fields of the parser map that become columns of their own
METADATA_FIELDS = (
    "title", "author", "subject", "keywords", "language", "page_count",
    "creation_date", "modification_date",
)


def merge_metadata(df: DataFrame, parsed: str = "parsed", derived: str = "derived") -> DataFrame:
    """Add ``metadata``: a parser's value where it has one, else the derived value.

    ``parsed`` is a map<string,string> of what the parser said; blanks count as
    missing, keywords become a list, unknown keys go to ``extra``.
    """

    def said(name: str) -> Column:
        return F.nullif(F.col(parsed)[name], F.lit(""))

    keywords = F.when(said("keywords").isNotNull(), tx.parse_keywords(said("keywords"))).otherwise(
        F.array().cast("array<string>"))
    return df.withColumn("metadata", F.struct(
        F.coalesce(said("title"), F.col(f"{derived}.title")).alias("title"),
        F.col(parsed)["author"].alias("author"),
        F.col(parsed)["subject"].alias("subject"),
        keywords.alias("keywords"),
        F.coalesce(said("language"), F.col(f"{derived}.language")).alias("language"),
        F.col(parsed)["page_count"].try_cast("int").alias("page_count"),
        F.col(f"{derived}.word_count").alias("word_count"),
        F.col(f"{derived}.char_count").alias("char_count"),
        tx.parse_iso_or_epoch(F.col(parsed)["creation_date"]).alias("creation_date"),
        tx.parse_iso_or_epoch(F.col(parsed)["modification_date"]).alias("modification_date"),
        F.map_filter(parsed, lambda k, v: ~k.isin(*METADATA_FIELDS)).alias("extra"),
    ))


def processing_stats(df: DataFrame, raw: str, cleaned: str, pages: Column) -> DataFrame:
    before, after = F.length(raw), F.length(cleaned)
    return (
        df.withColumn("page_count", pages)
        .withColumn("raw_char_count", before)
        .withColumn("clean_char_count", after)
        .withColumn("reduction", F.when(before > 0, 1.0 - after / before).otherwise(0.0))
    )


def processing_rollup(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stats.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("page_count").alias("pages"),
        F.sum("raw_char_count").alias("raw_chars"),
        F.sum("clean_char_count").alias("clean_chars"),
    )
