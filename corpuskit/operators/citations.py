"""Citations and prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: labels of the prompts -------------------------------------
CHUNK_HEAD, TITLE_DASH = "[Chunk ", " \u2014 "
STRATEGY_LABEL, COUNT_LABEL, TURNS_LABEL = "Strategy: ", "Context chunks: ", "Conversation turns: "
QUERY_LABEL, SUMMARY_LABEL = "Query: ", "Earlier conversation summary: "
HISTORY_LABEL, CONTEXT_LABEL = "Conversation history:\n", "Retrieved context:\n"
# ----------------------------------------------------------------------------

CITATION = (
    "array<struct<report_id:string,report_title:string,page_number:int,section_name:string,"
    "chunk_id:string,score:double,content:string>>"
)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def extract_citations(contexts: DataFrame, most: int = 10) -> DataFrame:
    """Citation rows per query: best score first, one per chunk (or source, or
    title where the ids are blank), at most ``most``."""
    key = F.coalesce(
        F.nullif(_text("chunk_id"), F.lit("")), F.nullif(_text("source_id"), F.lit("")), _text("source_title"))
    best = Window.partitionBy("query_id", "_key").orderBy(F.col("score").desc(), F.col("rank").asc())
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return (
        contexts.withColumn("_key", key).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") == 1)
        .withColumn("citation_rank", F.row_number().over(order)).filter(F.col("citation_rank") <= most)
        .select(
            "query_id", "citation_rank",
            F.when(_text("source_id") == "", _text("chunk_id")).otherwise(_text("source_id")).alias("report_id"),
            _text("source_title").alias("report_title"), F.col("page_number").cast("int").alias("page_number"),
            _text("section_name").alias("section_name"), _text("chunk_id").alias("chunk_id"), "score", "content"))


def citations_to_json(citations: DataFrame) -> DataFrame:
    """query_id, citations: a JSON list in rank order (at most ``most`` entries each)."""
    fields = ["report_id", "report_title", "page_number", "section_name", "chunk_id", "score", "content"]
    entries = F.array_sort(F.collect_list(F.struct("citation_rank", *fields)))
    return citations.groupBy("query_id").agg(entries.alias("_e")).select("query_id", F.to_json(
        F.transform("_e", lambda e: F.struct(*[e[f].alias(f) for f in fields]))).alias("citations"))


def citations_from_json(packed: DataFrame) -> DataFrame:
    return packed.select("query_id", F.posexplode(F.from_json("citations", CITATION)).alias("_i", "_c")).select(
        "query_id", (F.col("_i") + 1).alias("citation_rank"), "_c.*")


def unique_citations(contexts: DataFrame) -> DataFrame:
    """query_id, citations: distinct, in order of first appearance."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "citations")))
    return contexts.groupBy("query_id").agg(
        F.array_distinct(F.flatten(F.transform(rows, lambda r: r["citations"]))).alias("citations"))


def render_prompts(
    contexts: DataFrame, queries: DataFrame, strategy: str, history: DataFrame | None = None
) -> DataFrame:
    """query_id, system_prompt, user_prompt, num_chunks, prompt_hash.

    ``queries``: query_id, text, system_prompt [, summary];
    ``history``: query_id, lines (array of "role: content"), num_messages.
    """
    head = F.concat(F.lit(CHUNK_HEAD), F.col("rank").cast("string"), F.lit("]"))
    head = F.concat(head, F.when(_text("section_name") == "", "").otherwise(
        F.concat(F.lit(" ("), "section_name", F.lit(")"))))
    head = F.concat(head, F.when(_text("source_title") == "", "").otherwise(
        F.concat(F.lit(TITLE_DASH), "source_title")))
    block = F.concat(head, F.lit("\n"), "content")
    blocks = contexts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_b"))
    base = queries.join(blocks, "query_id", "left")
    if history is not None:
        base = base.join(history, "query_id", "left")
    n_chunks = F.coalesce(F.array_size("_b"), F.lit(0))
    meta = [
        F.lit(STRATEGY_LABEL + strategy) if strategy else None,
        F.when(n_chunks > 0, F.concat(F.lit(COUNT_LABEL), n_chunks.cast("string"))),
        F.when(F.col("num_messages") > 0, F.concat(F.lit(TURNS_LABEL), F.col("num_messages").cast("string")))
        if history is not None else None,
    ]
    lines = F.concat_ws("\n", *[m for m in meta if m is not None])
    system = F.when(lines == "", F.col("system_prompt")).otherwise(
        F.concat_ws("\n", "system_prompt", F.lit("---"), lines))
    user = F.concat_ws(
        "\n\n",
        F.when(_text("text") != "", F.concat(F.lit(QUERY_LABEL), "text")),
        *([F.when(_text("summary") != "", F.concat(F.lit(SUMMARY_LABEL), "summary"))]
          if "summary" in queries.columns else []),
        *([F.when(F.size("lines") > 0, F.concat(F.lit(HISTORY_LABEL), F.array_join("lines", "\n")))]
          if history is not None else []),
        F.when(n_chunks > 0, F.concat(
            F.lit(CONTEXT_LABEL),
            F.array_join(F.transform("_b", lambda b: b["block"]), "\n\n"))))
    return base.select(
        "query_id", system.alias("system_prompt"), user.alias("user_prompt"), n_chunks.alias("num_chunks")
    ).withColumn("prompt_hash", prompt_hash(F.col("system_prompt"), F.col("user_prompt")))


def prompt_hash(system: Column, user: Column) -> Column:
    """First 16 hex digits of the SHA-256 of both prompts."""
    return F.substring(F.sha2(F.concat_ws("\n", system, user), 256), 1, 16)


def format_excerpts(contexts: DataFrame, k: int) -> DataFrame:
    """query_id, text: the first ``k`` rows as numbered excerpts with their relevance."""
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] (relevance: "),
        F.format_string("%.2f", F.col("score")), F.lit(")\n"), "content")
    rows = contexts.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_r"))
    return rows.select("query_id", F.array_join(F.transform("_r", lambda r: r["b"]), "\n\n---\n\n").alias("text"))
