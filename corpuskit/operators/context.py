"""Context assembly: from ranked chunks per query to a bounded prompt context.

Input rows are the retrieved chunks: query_id, pos (arrival order), chunk_id,
content, score, source_id, source_title, section_name, page_number,
citations array<string> [, source_version, parent_chunk_id, token_count,
metadata map].  A query has as many rows as its retrieval returned (top-k), so
windows per query are small.  Chat histories have no such bound and go through
the block-wise operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators.ordered import ordered_text, row_position, running_total
from corpuskit.operators.skew import join_copies

# --- fixed values -----------------------------------------------------------
MAX_TOKENS, SYSTEM_TOKENS, RESERVED_TOKENS = 8192, 150, 256
HISTORY_TOKENS, CHUNK_TOKENS = 1024, 6144
MAX_CHUNKS, MAX_MESSAGES = 15, 20
MULTI_INTRO = "You are a helpful multi-document analysis assistant. The user is referencing: "
COMPARISON_INTRO = (
    "You are a comparison analysis assistant. Compare and contrast the following sources: ")
ASKED_ABOUT = "\nThe user is asking about: "
CONTEXT_TITLE, CONTEXT_RULE = "## Context for: ", "---\n"
QUERY_LABEL, SUMMARY_LABEL = "Query: ", "Conversation Summary: "
CHUNK_LABEL, PAGE_LABEL = "Chunk ", " (p. "
KEY_CHARS, SMALLEST_CUT, SUMMARY_CHARS = 80, 64, 200
GROUNDING = (
    "You are a document analysis assistant. Answer STRICTLY from the retrieved context.\n"
    "Rules:\n"
    "1. Base every claim on the retrieved context. Never use outside knowledge.\n"
    "2. Use the context to answer: extract the relevant facts, and aggregate or "
    "compare across chunks when the question asks for it (e.g. highest/lowest, "
    "totals, distributions).\n"
    "3. For each fact you state, cite the chunk it came from as [Chunk N].\n"
    "4. Do not add general knowledge, extra examples, or elaborations "
    "not present in the context.\n"
    "5. Only if the context genuinely has none of the information needed, "
    "answer exactly: \"The retrieved context doesn't cover this question.\"\n"
    "6. If only part of the answer is in the context, answer that part "
    "and note the rest is not covered."
)
# ----------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Four characters per token; an empty text has none."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(tx.tokens_estimate(c))


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def by_score(df: DataFrame, order: str = "pos") -> DataFrame:
    """``rank`` by score, best first; equal scores keep their ``order``."""
    window = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(order).asc())
    return df.withColumn("rank", F.row_number().over(window))


def _rerank(df: DataFrame) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy("rank")
    return df.withColumn("rank", F.row_number().over(window))


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Best-ranked row per chunk id, or per opening of the content where the id is blank."""
    key = F.when(_blank(F.col("chunk_id")), F.substring("content", 1, KEY_CHARS)).otherwise(F.col("chunk_id"))
    first = Window.partitionBy("query_id", "_key").orderBy("rank")
    return _rerank(
        df.withColumn("_key", key).withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1).drop("_key", "_n"))


def merge_adjacent(df: DataFrame) -> DataFrame:
    """Join consecutive ranks of one source, section and title into one row."""
    window = Window.partitionBy("query_id").orderBy("rank")
    same = (
        (F.col("source_id") == F.lag("source_id").over(window)) & ~_blank(F.col("source_id"))
        & F.col("section_name").eqNullSafe(F.lag("section_name").over(window))
        & F.col("source_title").eqNullSafe(F.lag("source_title").over(window)))
    marked = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(
        "_island", F.sum("_new").over(window))
    rows = F.array_sort(F.collect_list(F.struct("rank", "content", "citations")))
    merged = marked.groupBy("query_id", "_island").agg(
        F.min("rank").alias("rank"), F.min_by("chunk_id", "rank").alias("chunk_id"),
        rows.alias("_rows"), F.max("score").alias("score"),
        F.first("source_id").alias("source_id"), F.first("source_title").alias("source_title"),
        F.first("section_name").alias("section_name"),
        F.min_by("page_number", F.when(F.col("page_number").isNotNull(), F.col("rank"))).alias("page_number"),
        F.sum("token_count").alias("token_count"))
    return _rerank(merged.select(
        "query_id", "rank", "chunk_id",
        F.array_join(F.transform("_rows", lambda r: F.coalesce(r["content"], F.lit(""))), "\n").alias("content"),
        "score", "source_id", "source_title", "section_name", "page_number", "token_count",
        F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["citations"]))).alias("citations")))


def mark_parents(df: DataFrame, parent: str = "parent_chunk_id") -> DataFrame:
    """Cite ``parent:<id>`` where the parent chunk is not among the query's rows."""
    present = F.collect_set("chunk_id").over(Window.partitionBy("query_id"))
    missing = ~_blank(F.col(parent)) & ~F.array_contains("_present", F.col(parent))
    return df.withColumn("_present", present).withColumn("citations", F.when(
        missing, F.concat("citations", F.array(F.concat(F.lit("parent:"), F.col(parent))))
    ).otherwise(F.col("citations"))).drop("_present")


def default_citation(df: DataFrame) -> DataFrame:
    bare = (F.size("citations") == 0) & (F.col("score") > 0) & ~_blank(F.col("source_id"))
    return df.withColumn("citations", F.when(bare, F.array("source_id")).otherwise(F.col("citations")))


def select_context(
    df: DataFrame, max_chunks: int = MAX_CHUNKS, merge: bool = False, dedupe: bool = True, parents: bool = True
) -> DataFrame:
    """Sort, deduplicate, optionally merge, mark parents, default citation, cut."""
    df = by_score(df)
    if dedupe:
        df = remove_duplicates(df)
    if merge:
        df = merge_adjacent(df)
    if parents and "parent_chunk_id" in df.columns:
        df = mark_parents(df)
    return default_citation(df).filter(F.col("rank") <= max_chunks)


def enrich(df: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """Fill missing title, version, page, section and source; the rest of
    ``extra`` goes into ``metadata``, where it wins."""
    targets = {
        "report_title": "source_title", "report_version": "source_version",
        "section_name": "section_name", "source_id": "source_id",
    }
    for name, column in targets.items():
        if name in extra:
            df = df.withColumn(column, F.when(_blank(F.col(column)), extra[name]).otherwise(F.col(column)))
    if "page_number" in extra:
        df = df.withColumn("page_number", F.coalesce("page_number", extra["page_number"].cast("int")))
    bare = (F.size("citations") == 0) & ~_blank(F.col("source_id"))
    df = df.withColumn("citations", F.when(bare, F.array("source_id")).otherwise(F.col("citations")))
    rest = {k: v for k, v in extra.items() if k not in targets and k != "page_number"}
    if rest:
        added = F.create_map(*[x for k, v in rest.items() for x in (F.lit(k), v.cast("string"))])
        kept = F.map_filter("metadata", lambda k, v: ~k.isin(*rest))
        df = df.withColumn("metadata", F.map_concat(kept, added))
    return df


# --- strategies -------------------------------------------------------------


def _source(df: DataFrame) -> DataFrame:
    name = F.coalesce(
        F.nullif(F.col("source_id"), F.lit("")), F.nullif(F.col("source_title"), F.lit("")), F.lit("unknown"))
    return df.withColumn("_source", name)


def assemble_single(df: DataFrame, n: int = 20) -> DataFrame:
    return by_score(df, "rank").filter(F.col("rank") <= n)


def single_prompt(df: DataFrame) -> DataFrame:
    """query_id, system_prompt: the grounding rules and the titles asked about."""
    titles = F.array_sort(F.collect_set(F.nullif(F.col("source_title"), F.lit(""))))
    return df.groupBy("query_id").agg(titles.alias("_t")).select("query_id", F.when(
        F.size("_t") > 0,
        F.concat(F.lit(GROUNDING + ASKED_ABOUT), F.array_join("_t", ", "), F.lit(".")),
    ).otherwise(GROUNDING).alias("system_prompt"))


def assemble_multi(df: DataFrame, max_per_doc: int = 10) -> DataFrame:
    """The best rows of every source, ranked together again."""
    inside = Window.partitionBy("query_id", "_source").orderBy(F.col("score").desc(), F.col("rank"))
    kept = _source(df).withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= max_per_doc)
    return by_score(kept, "rank").drop("_n", "_source")


def multi_prompt(df: DataFrame) -> DataFrame:
    named = _source(df).groupBy("query_id", "_source").agg(F.min("rank").alias("_first"))
    listed = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_first", "_source"))).alias("_s"))
    names = F.transform("_s", lambda s: s["_source"])
    shown = F.when(F.size("_s") <= 3, F.array_join(names, ", ")).otherwise(
        F.concat(F.size("_s").cast("string"), F.lit(" documents")))
    return listed.select("query_id", F.concat(
        F.lit(MULTI_INTRO), shown, F.lit("."),
    ).alias("system_prompt"))


def assemble_comparison(df: DataFrame, max_per_source: int = 8) -> DataFrame:
    """Sources in first-seen order, one row of each per round."""
    inside = Window.partitionBy("query_id", "_source").orderBy(F.col("score").desc(), F.col("rank"))
    group = Window.partitionBy("query_id", "_source")
    laid = (
        _source(df).withColumn("_round", F.row_number().over(inside))
        .withColumn("_seen", F.min("rank").over(group))
        .filter(F.col("_round") <= max_per_source))
    turn = Window.partitionBy("query_id").orderBy("_round", "_seen")
    return laid.withColumn("rank", F.row_number().over(turn)).drop("_round", "_seen", "_source")


def comparison_prompt(df: DataFrame) -> DataFrame:
    names = F.slice(F.array_sort(F.collect_set("_source")), 1, 5)
    return _source(df).groupBy("query_id").agg(F.concat(
        F.lit(COMPARISON_INTRO),
        F.array_join(names, ", "), F.lit(".")).alias("system_prompt"))


def assemble_summary(df: DataFrame, n: int = 5) -> DataFrame:
    """The best ``n`` rows as one: joined content, top score, citations in first-seen order."""
    top = by_score(df, "rank").filter(F.col("rank") <= n)
    rows = F.array_sort(F.collect_list(F.struct("rank", "content", "citations")))
    return top.groupBy("query_id").agg(rows.alias("_r"), F.max("score").alias("score")).select(
        "query_id", F.lit(1).alias("rank"), F.lit("summary_combined").alias("chunk_id"),
        F.array_join(F.transform("_r", lambda r: r["content"]), "\n\n").alias("content"), "score",
        F.array_distinct(F.flatten(F.transform("_r", lambda r: r["citations"]))).alias("citations"),
    ).withColumn("token_count", F.floor(F.length("content") / 4).cast("int"))


# --- budgets ----------------------------------------------------------------


def allocate_budget(
    contexts: DataFrame, queries: DataFrame, history: DataFrame | None = None,
    total: int = MAX_TOKENS, system: int = SYSTEM_TOKENS, reserved: int = RESERVED_TOKENS,
    history_cap: int = HISTORY_TOKENS, chunk_cap: int = CHUNK_TOKENS,
) -> DataFrame:
    """Token shares per query.  ``queries``: query_id, text; ``history``: query_id, content."""
    wanted = contexts.groupBy("query_id").agg(F.sum(tokens(F.col("content"))).alias("_chunks"))
    base = queries.select("query_id", tokens(F.col("text")).alias("user_query")).join(wanted, "query_id", "left")
    if history is None:
        base = base.withColumn("_history", F.lit(0))
    else:
        said = history.groupBy("query_id").agg(F.sum(tokens(F.col("content"))).alias("_history"))
        base = base.join(said, "query_id", "left")
    past = F.least(F.coalesce("_history", F.lit(0)), F.lit(history_cap)).cast("int")
    chunks = F.least(F.coalesce("_chunks", F.lit(0)), F.lit(chunk_cap)).cast("int")
    spare = F.lit(total - system - reserved) - F.col("user_query") - past - chunks
    return base.select(
        "query_id", F.lit(total).alias("total"), F.lit(system).alias("system_prompt"),
        F.lit(reserved).alias("reserved"), "user_query", past.alias("conversation_history"),
        chunks.alias("retrieved_chunks"), F.greatest(F.lit(0), spare).alias("metadata")
    ).withColumn(
        "allocated",
        F.col("system_prompt") + F.col("reserved") + F.col("user_query") + F.col("conversation_history")
        + F.col("retrieved_chunks") + F.col("metadata"),
    ).withColumn("remaining", F.col("total") - F.col("allocated"))


def _until_overflow(df: DataFrame, cost: Column, cap: Column) -> DataFrame:
    """Keep rows while the running cost fits, plus the first row that does not.

    Adds ``_used`` (cost before the row), ``_cost`` and ``_over``.
    """
    window = Window.partitionBy("query_id").orderBy("rank")
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_cost", cost).withColumn("_cap", cap)
    df = df.withColumn("_used", F.coalesce(F.sum("_cost").over(before), F.lit(0)))
    df = df.withColumn("_over", F.col("_used") + F.col("_cost") > F.col("_cap"))
    # Costs are not negative: once over, the running sum stays over, and only
    # the first such row has no overflow before it.
    earlier = F.coalesce(F.max("_over").over(before), F.lit(False))
    return df.withColumn("_late", earlier).filter(~F.col("_late")).drop("_late")


def enforce_budget(df: DataFrame, budgets: DataFrame) -> DataFrame:
    """Cut to ``retrieved_chunks`` tokens: the first row that does not fit is
    shortened in proportion if over 64 tokens are left, and the list ends there."""
    own = F.when(F.coalesce("token_count", F.lit(0)) > 0, F.col("token_count")).otherwise(tokens(F.col("content")))
    kept = _until_overflow(
        df.join(budgets.select("query_id", "retrieved_chunks"), "query_id"), own, F.col("retrieved_chunks"))
    left = F.col("_cap") - F.col("_used")
    fits = kept.filter(~F.col("_over") | ((left > SMALLEST_CUT) & (F.col("_cost") > left)))
    chars = F.floor(F.length("content") * (left / F.col("_cost"))).cast("int")
    return (
        fits.withColumn("content", F.when(F.col("_over"), F.substring("content", F.lit(1), chars))
                        .otherwise(F.col("content")))
        .withColumn("token_count", F.when(F.col("_over"), left).otherwise(F.col("_cost")).cast("int"))
        .drop("_cost", "_cap", "_used", "_over", "retrieved_chunks"))


def truncate_chunks(df: DataFrame, window_tokens: int = 4096, response: int = 1024, system: int = 500) -> DataFrame:
    """Half of what the window leaves (256 at least) for chunks, best first; the
    first overflowing row is cut to the rest if over 80 characters remain."""
    limit = max(256, (window_tokens - response - system) // 2)
    kept = _until_overflow(by_score(df), tokens(F.col("content")), F.lit(limit))
    chars = (F.col("_cap") - F.col("_used")) * 4
    fits = kept.filter(~F.col("_over") | ((chars > 80) & (F.length("content") > 0)))
    return (
        fits.withColumn("content", F.when(F.col("_over"), F.substring("content", F.lit(1), chars.cast("int")))
                        .otherwise(F.col("content")))
        .withColumn("token_count", tokens(F.col("content")))
        .drop("_cost", "_cap", "_used", "_over"))


def build_context_text(df: DataFrame, queries: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """query_id, text: header and chunks in rank order up to the first that does not fit."""
    quarter = lambda c: F.floor(F.length(c) / 4).cast("int")
    asked = queries.select("query_id", F.col("text").alias("_query"))
    rows = df.join(asked, "query_id")
    kept = _until_overflow(rows, quarter("content"), F.lit(max_tokens) - quarter("_query")).filter(~F.col("_over"))
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    body = kept.groupBy("query_id").agg(parts.alias("_p"))
    blocks = F.transform("_p", lambda p: F.concat(F.lit(CONTEXT_RULE), p["content"], F.lit("\n")))
    return asked.join(body, "query_id", "left").select("query_id", F.concat(
        F.lit(CONTEXT_TITLE), "_query", F.lit("\n\n"),
        F.coalesce(F.array_join(blocks, ""), F.lit(""))).alias("text"))


def render_full_text(df: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, text: system prompt, query, then numbered chunks.

    ``queries``: query_id, text [, system_prompt, summary].
    """
    head = F.concat(F.lit(CHUNK_LABEL), F.col("rank").cast("string"))
    head = F.concat(head, F.when(_blank(F.col("section_name")), "").otherwise(
        F.concat(F.lit(" ["), "section_name", F.lit("]"))))
    head = F.concat(head, F.when(F.col("page_number").isNull(), "").otherwise(
        F.concat(F.lit(PAGE_LABEL), F.col("page_number").cast("string"), F.lit(")"))))
    line = F.concat(head, F.lit(": "), "content")
    rows = df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_r"))
    optional = [
        F.nullif(F.col("system_prompt"), F.lit("")) if "system_prompt" in queries.columns else None,
        F.when(~_blank(F.col("_q")), F.concat(F.lit(QUERY_LABEL), "_q")),
        F.concat(F.lit(SUMMARY_LABEL), "summary") if "summary" in queries.columns else None,
    ]
    asked = queries.withColumnRenamed("text", "_q")
    return asked.join(rows, "query_id", "left").select("query_id", F.concat_ws(
        "\n\n", *[c for c in optional if c is not None],
        F.transform("_r", lambda r: r["line"])).alias("text"))


def context_stats(
    df: DataFrame, budgets: DataFrame, messages: DataFrame | None = None,
    max_chunks: int = MAX_CHUNKS, max_messages: int = MAX_MESSAGES,
) -> DataFrame:
    """Size, token usage and utilisation per query.  ``messages``: query_id, n."""
    sizes = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("context_size"))
    base = budgets.select("query_id", F.col("allocated").alias("token_usage")).join(sizes, "query_id", "left")
    if messages is None:
        base = base.withColumn("n", F.lit(0))
    else:
        base = base.join(messages, "query_id", "left")
    return base.select(
        "query_id", F.coalesce("context_size", F.lit(0)).alias("context_size"), "token_usage",
        (F.coalesce("n", F.lit(0)) / max_messages).alias("history_utilization"),
        (F.coalesce("context_size", F.lit(0)) / max_chunks).alias("retrieval_utilization"))


def mean_context_stats(stats: DataFrame) -> DataFrame:
    names = ["context_size", "token_usage", "history_utilization", "retrieval_utilization"]
    return stats.agg(F.count(F.lit(1)).alias("num_runs"), *[F.avg(n).alias(f"mean_{n}") for n in names])


# --- conversation history ---------------------------------------------------


def _counted(messages: DataFrame) -> DataFrame:
    totals = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("copies"))
    return join_copies(
        messages, totals.withColumnRenamed("copies", "_total"), ["session_id"], totals)


def trim_history(messages: DataFrame, max_messages: int = MAX_MESSAGES, max_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """Histories over ``max_messages`` keep their newest messages while these fit
    ``max_tokens``; shorter ones pass untouched.  Input: session_id, position
    (a number rising with time), content."""
    counted = _counted(messages)
    short = counted.filter(F.col("_total") <= max_messages).select(*messages.columns)
    long = counted.filter(F.col("_total") > max_messages).select(*messages.columns)
    # Counting back from the newest, the sum only grows: everything before the
    # first overflow is exactly what has a running sum within the cap.
    kept = running_total(
        long, ["session_id"], "position", tokens(F.col("content")), "_sum", descending=True
    ).filter(F.col("_sum") <= max_tokens)
    return short.unionByName(kept.drop("_sum"))


def history_pieces(messages: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """All but the newest messages, shortened: session_id, number (from 1), piece.

    Every second piece carries its role.  One row per message, so a session of
    any length is spread over tasks.
    """
    numbered = row_position(_counted(messages), ["session_id"], "position", "number")
    old = numbered.filter(F.col("number") <= F.col("_total") - max_messages)
    prefix = F.when((F.col("number") - 1) % 2 == 0, F.concat("role", F.lit(": "))).otherwise("")
    return old.select("session_id", "number", F.concat(prefix, F.substring("content", 1, SUMMARY_CHARS)).alias("piece"))


def history_summary(messages: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """One row per session with older messages: session_id, text, token_count, message_count.

    The pieces of ``history_pieces`` in order.  A long session is joined lot by
    lot in many tasks; only its lots meet in one.
    """
    return ordered_text(
        history_pieces(messages, max_messages), ["session_id"], "number", "piece", " | ", "text",
        {"token_count": F.floor(F.length("piece") / 4), "message_count": F.lit(1)})
