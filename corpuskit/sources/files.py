"""Reading documents and evaluation sets, and admitting uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.schemas import EVAL_SET

# fixed values: what may enter, and how large it may be
TEXT_EXTENSIONS = ("txt", "md", "csv")
ALLOWED_EXTENSIONS = ("pdf", "docx", "txt", "md", "csv")
MAX_BYTES = 50 * 1024 * 1024


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """txt, md and csv files as one-page documents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return text_documents(
        files.filter(extension.isin(*TEXT_EXTENSIONS)).select(
            "path", F.decode("content", "UTF-8").alias("text"), "length", "modificationTime"))


def text_documents(df: DataFrame) -> DataFrame:
    """path and text to document columns: title (file stem), extension, counts, one page."""
    name = F.regexp_extract("path", r"([^/]*)/*$", 1)
    content = F.col("text")
    return (
        df.withColumn("title", F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
        .withColumn("extension", F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
        .withColumn("line_count", F.size(tx.lines(content)))
        .withColumn("char_count", F.length(content))
        .withColumn("word_count", tx.word_count(content))
        .withColumn("page_count", F.lit(1))
    )


def documents_to_pages(df: DataFrame) -> DataFrame:
    """doc_id, page_number (from 1), content, char_count, word_count; pages end at form feeds."""
    return (
        df.select("doc_id", F.posexplode(F.split("text", "\f")).alias("_i", "content"))
        .select("doc_id", (F.col("_i") + 1).alias("page_number"), "content",
                F.length("content").alias("char_count"),
                tx.word_count(F.col("content")).alias("word_count"))
    )


def reject_reason(
    name: Column, size: Column, chars: Column, extensions: Sequence[str] = ALLOWED_EXTENSIONS,
    max_bytes: int = MAX_BYTES, max_chars: int | None = None,
) -> Column:
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    reason = F.when(~extension.isin(*extensions), "invalid_file_extension").when(
        size > max_bytes, "file_too_large")
    return reason if max_chars is None else reason.when(chars > max_chars, "expanded_text_too_large")


def admit_documents(df: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``reject_reason``); input has name, size, text."""
    judged = df.withColumn(
        "reject_reason", reject_reason(F.col("name"), F.col("size"), F.length("text"), **limits))
    return (judged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            judged.filter(F.col("reject_reason").isNotNull()))


def with_checksum(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn("checksum", F.sha2(column, 256))


def read_eval_sets(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth files: one row per question with its document and topics."""
    sets = spark.read.schema(EVAL_SET).option("multiLine", "true").json(path)
    return sets.select("document", "document_path", "topic", F.explode("queries").alias("q")).select(
        "document", "document_path", "topic", F.col("q.id").alias("query_id"), F.col("q.query").alias("text"),
        F.col("q.expected_topics").alias("topics"), F.col("q.expected_grounded").alias("expected_grounded"))


def eval_run_rows(results: DataFrame, metrics: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run with a metrics map; per-question rows stay a table of their own.

    ``metrics``: run keys and one double column per metric.
    """
    names = [c for c in metrics.columns if c not in keys]
    pairs = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    counts = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_results"))
    return metrics.select(*keys, pairs.alias("metrics")).join(counts, list(keys), "left")


def write_results(results: DataFrame, runs: DataFrame, path: str) -> None:
    """Append a run and its per-question rows below ``path``."""
    runs.write.mode("append").parquet(f"{path}/runs")
    results.write.mode("append").parquet(f"{path}/results")
