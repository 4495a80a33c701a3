"""Checks that turn tables into tables of findings.

A finding has an entity, ``check_name`` and ``severity``: ``error`` makes the
entity invalid, ``warning`` does not, and ``strict`` turns warnings into errors.
Row checks run in one pass over the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.functions import vectors as vx
from corpuskit.operators.ordered import earlier_values, with_neighbour
from corpuskit.operators.skew import join_copies
from corpuskit.session import kept_table


def _rows(df: DataFrame, keep: Sequence[Column], checks: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """One output row per failed check, all checks evaluated in a single scan."""
    failed = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.struct(
            F.lit(name).alias("check_name"), F.lit(severity).alias("severity")))
        for name, severity, bad in checks]))
    return df.select(*keep, F.explode(failed).alias("_f")).select(
        *[c for c in df.select(*keep).columns], "_f.check_name", "_f.severity")


def promote(findings: DataFrame, strict: bool) -> DataFrame:
    return findings.withColumn("severity", F.lit("error")) if strict else findings


# --- chunks -----------------------------------------------------------------


def chunk_findings(
    chunks: DataFrame, min_size: int = 100, max_size: int = 2000, strict: bool = False
) -> DataFrame:
    """doc_id, chunk_index, check_name, severity.

    Input: doc_id, chunk_index, text, page_number, start_offset, end_offset.
    """
    size = F.length("text")
    keys = [F.col("doc_id"), F.col("chunk_index")]
    ahead = with_neighbour(chunks, ["doc_id"], "chunk_index", ["chunk_index"], "_next")
    local = _rows(ahead, keys, [
        ("empty", "error", tx.is_blank(F.col("text"))),
        ("oversized", "warning", size > max_size),
        ("tiny", "warning", (size < min_size) & F.col("_next").isNotNull()),
        ("page_number", "warning", F.col("page_number").isNull()),
        ("negative_offset", "error", (F.col("start_offset") < 0) | (F.col("end_offset") < 0)),
        ("inverted_offset", "error", F.col("start_offset") > F.col("end_offset")),
    ])
    return promote(
        local.unionByName(overlap_findings(chunks))
        .unionByName(duplicate_chunks(chunks).select(
            *keys, F.lit("duplicate").alias("check_name"), F.lit("warning").alias("severity"))),
        strict)


def overlap_findings(chunks: DataFrame) -> DataFrame:
    """Chunks that start before the chunk ahead of them (by start offset) ends."""
    placed = chunks.select("doc_id", "chunk_index", "start_offset", "end_offset")
    behind = with_neighbour(
        placed, ["doc_id"], ["start_offset", "chunk_index"], ["end_offset"], "_before", step=-1)
    return _rows(behind, [F.col("doc_id"), F.col("chunk_index")], [
        ("overlap", "warning", F.col("start_offset") < F.col("_before.end_offset"))])


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """Repeats of an earlier chunk text of the document.

    doc_id, chunk_index, duplicate_of (first index), earlier_copies, earlier (their
    indices in order).  A text with n copies gives n * (n - 1) / 2 indices in all;
    ``earlier_copies`` is their number where the list is not wanted.
    """
    keyed = chunks.select("doc_id", "chunk_index", F.sha2("text", 256).alias("text_key"))
    keys = ["doc_id", "text_key"]
    groups = keyed.groupBy(*keys).agg(
        F.min("chunk_index").alias("duplicate_of"), F.count(F.lit(1)).alias("copies")
    ).filter(F.col("copies") > 1)
    repeated = join_copies(keyed, groups.drop("copies"), keys, groups)
    return (
        earlier_values(repeated, keys, "chunk_index", "chunk_index", "earlier")
        .filter(F.col("chunk_index") > F.col("duplicate_of"))
        .select("doc_id", "chunk_index", "duplicate_of", F.size("earlier").cast("long").alias("earlier_copies"), "earlier")
    )


def verdicts(entities: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Per entity: valid, errors, warnings, and how often each check failed."""
    per_check = findings.groupBy(key, "check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
    merged = per_check.groupBy(key).agg(
        F.sum(F.when(F.col("severity") == "error", F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.col("severity") == "warning", F.col("n")).otherwise(0)).alias("warnings"),
        F.array_sort(F.collect_set("check_name")).alias("failed_checks"),
    )
    none = F.array().cast("array<string>")
    return entities.select(key).distinct().join(merged, key, "left").select(
        key,
        (F.coalesce("errors", F.lit(0)) == 0).alias("valid"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
        F.coalesce("failed_checks", none).alias("failed_checks"))


# --- vectors ----------------------------------------------------------------


def embedding_findings(df: DataFrame, key: str, dims: int | None = None, strict: bool = False) -> DataFrame:
    v = F.col("embedding")
    missing = v.isNull() | (F.size(v) == 0)
    checks = [("empty", "error", missing), ("nan", "error", vx.has_nan(v)), ("inf", "error", vx.has_inf(v))]
    if dims is not None:
        checks.append(("dimensions", "error", F.size(v) != dims))
    return promote(_rows(df, [F.col(key).alias("entity_id")], checks), strict)


def _within(a: Column, b: Column, tolerance: float) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return (F.size(a) == F.size(b)) & ~F.exists(gaps, lambda g: ~(g <= tolerance))


def _cells(v: Column, tolerance: float) -> Column:
    """Grid cells of a vector, as hashes: its own, and across any border nearer
    than the tolerance.  Two vectors within tolerance share at least one cell.

    Cells are 4096 tolerances wide and shifted, so that round numbers such as 0
    do not sit on borders; a second cell in some dimension is then rare.
    """
    width = 4096 * tolerance
    shift = 0.381966 * width

    def step(states: Column, x: Column) -> Column:
        low = F.floor((x - tolerance + shift) / width)
        high = F.floor((x + tolerance + shift) / width)
        here = F.transform(states, lambda h: F.xxhash64(h, low))
        beside = F.transform(states, lambda h: F.xxhash64(h, high))
        return F.when(low == high, here).otherwise(F.concat(here, beside))

    return F.aggregate(v, F.array(F.xxhash64(F.size(v))), step)


def embedding_duplicates(df: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """entity_id, duplicate_of: the smallest earlier id whose vector is equal
    within ``tolerance`` in every component.

    Exact copies are folded first, so a huge group of them is one vector from
    then on.  Near copies meet in grid cells: each is tried against the smallest
    id of its cell, and only what that leaves open is compared within the cell.
    """
    # The last candidate bound of a cell is inclusive of float error at the rim.
    # NaN is not within any tolerance of anything, itself included.
    rows = df.filter((F.size("embedding") > 0) & ~F.coalesce(vx.has_nan(F.col("embedding")), F.lit(False))).select(
        F.col(key).alias("entity_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    folded = rows.groupBy("vector").agg(
        F.min("entity_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    cells = folded.select("rep", "vector", F.explode(_cells(F.col("vector"), tolerance)).alias("cell"))
    shared = cells.groupBy("cell").agg(
        F.min("rep").alias("pivot"), F.min_by("vector", "rep").alias("pivot_vector"),
        F.count(F.lit(1)).alias("copies"),
    ).filter(F.col("copies") > 1)
    tried = join_copies(cells, shared.drop("copies"), ["cell"], shared.select("cell", "copies")).filter(
        F.col("rep") != F.col("pivot")
    ).withColumn("near", _within(F.col("vector"), F.col("pivot_vector"), tolerance))
    settled = tried.filter("near").select("rep", F.col("pivot").alias("match"))
    open_rows = tried.filter(~F.col("near")).select("cell", "rep", "vector")
    compared = (
        open_rows.join(cells.toDF("other", "other_vector", "cell"), "cell")
        .filter((F.col("other") < F.col("rep")) & _within(F.col("vector"), F.col("other_vector"), tolerance))
        .select("rep", F.col("other").alias("match"))
    )
    best = settled.unionByName(compared).groupBy("rep").agg(F.min("match").alias("match"))
    known = folded.join(best, "rep", "left").select(
        "vector", F.least("rep", F.coalesce("match", "rep")).alias("duplicate_of"))
    return (
        join_copies(rows, known, ["vector"], folded.select("vector", "copies"))
        .filter(F.col("duplicate_of") < F.col("entity_id"))
        .select("entity_id", "duplicate_of")
    )


def index_findings(df: DataFrame, dims: int | None = None, strict: bool = False) -> DataFrame:
    """entity_id (chunk), check_name, severity, n (rows concerned)."""
    v = F.col("embedding")
    checks = [
        ("empty", "error", v.isNull() | (F.size(v) == 0)),
        ("nan", "error", vx.has_nan(v)),
        ("inf", "error", vx.has_inf(v)),
        ("missing_report", "warning", F.coalesce("report_id", F.lit("")) == ""),
        ("missing_version", "warning", F.coalesce("version_id", F.lit("")) == ""),
    ]
    if dims is not None:
        checks.append(("dimensions", "error", F.size(v) != dims))
    found = _rows(df, [F.col("chunk_id").alias("entity_id")], checks).groupBy(
        "entity_id", "check_name", "severity").agg(F.count(F.lit(1)).alias("n"))
    repeated = (
        df.groupBy(F.col("chunk_id").alias("entity_id")).agg((F.count(F.lit(1)) - 1).alias("n"))
        .filter("n > 0")
        .select("entity_id", F.lit("duplicate_id").alias("check_name"), F.lit("error").alias("severity"), "n")
    )
    return promote(found.unionByName(repeated), strict)


# --- hits, contexts, messages, answers --------------------------------------


def retrieval_findings(hits: DataFrame, strict: bool = False, queries: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, rank, check_name, severity for ranked hits (k rows per query).

    With ``queries`` (query_id) those without any hit are found too, with a null
    chunk and rank; the hits are stored then, without their content, for two readers.
    """
    from pyspark.sql import Window

    hits = hits.select("query_id", "chunk_id", "rank", "score", (F.coalesce("content", F.lit("")) == "").alias("_blank"))
    if queries is not None:
        hits = kept_table(hits, "hits")

    by_rank = Window.partitionBy("query_id").orderBy("rank")
    same_chunk = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    seen = hits.withColumn("_before", F.lag("score").over(by_rank)).withColumn(
        "_copy", F.row_number().over(same_chunk))
    s = F.col("score")
    chunk = F.coalesce(F.col("chunk_id").cast("string"), F.lit(""))
    found = _rows(seen, [F.col("query_id"), F.col("chunk_id"), F.col("rank")], [
        ("duplicate_id", "error", F.col("_copy") > 1),
        ("nan_score", "error", F.isnan(s)),
        ("inf_score", "error", F.abs(s) == float("inf")),
        ("score_range", "warning", ~F.isnan(s) & ((s < 0) | (s > 1))),
        ("order", "error", s > F.col("_before") + 1e-9),
        ("empty_id", "warning", chunk == ""),
        ("empty_content", "warning", F.col("_blank")),
    ])
    if queries is not None:
        kinds = dict(hits.dtypes)
        found = found.unionByName(
            queries.select("query_id").distinct().join(hits.select("query_id"), "query_id", "left_anti").select(
                "query_id", F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"),
                F.lit(None).cast(kinds["rank"]).alias("rank"), F.lit("empty_result").alias("check_name"),
                F.lit("warning").alias("severity")))
    return promote(found, strict)


def context_findings(contexts: DataFrame, totals: DataFrame) -> DataFrame:
    """query_id, chunk_id, check_name, severity for assembled contexts.

    ``contexts``: query_id, rank, chunk_id, content, source_id, citations array.
    ``totals``: query_id, total, allocated (token budget).
    """
    from pyspark.sql import Window

    copy = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    chunk = [F.col("query_id"), F.col("chunk_id").cast("string").alias("chunk_id")]
    local = _rows(contexts.withColumn("_copy", F.row_number().over(copy)), chunk, [
        ("duplicate", "warning", F.col("_copy") > 1),
        ("missing_source", "warning", F.coalesce("source_id", F.lit("")) == ""),
        ("empty_content", "error", F.coalesce("content", F.lit("")) == ""),
    ])
    budget = _rows(totals, [F.col("query_id"), F.lit(None).cast("string").alias("chunk_id")], [
        ("budget_total", "error", F.col("total") <= 0),
        ("over_budget", "warning", F.col("allocated") > F.col("total")),
    ])
    parents = contexts.select(*chunk, F.explode("citations").alias("citation")).filter(
        F.col("citation").startswith("parent:")
    ).withColumn("parent", F.substring("citation", 8, 1 << 30))
    present = contexts.select("query_id", F.col("chunk_id").cast("string").alias("parent")).distinct()
    broken = parents.join(present, ["query_id", "parent"], "left_anti").select(
        "query_id", "chunk_id", F.lit("broken_parent").alias("check_name"), F.lit("warning").alias("severity"))
    return local.unionByName(budget).unionByName(broken)


MESSAGE_LIMIT = 10000
MODES = ("single", "multi", "comparison")


def message_findings(messages: DataFrame, key: str, limit: int = MESSAGE_LIMIT) -> DataFrame:
    return _rows(messages, [F.col(key).alias("entity_id")], [
        ("empty_message", "error", tx.is_blank(F.col("content"))),
        ("too_long", "error", F.length("content") > limit),
    ])


def session_findings(sessions: DataFrame, key: str) -> DataFrame:
    return _rows(sessions, [F.col(key).alias("entity_id")], [
        ("invalid_mode", "error", ~F.col("mode").isin(*MODES)),
        ("archived", "error", F.col("archived")),
    ])


def citation_findings(citations: DataFrame, answers: DataFrame) -> DataFrame:
    """Citations whose title does not occur in the answer; answers without citations.

    ``citations``: query_id, report_title; ``answers``: query_id, answer.
    """
    title = F.lower("report_title")
    absent = (
        citations.join(answers, "query_id")
        .filter((title != "") & (F.instr(F.lower("answer"), title) == 0))
        .select("query_id", "report_title", F.lit("title_not_found").alias("check_name"))
    )
    bare = answers.join(citations.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit(None).cast("string").alias("report_title"),
        F.lit("no_citations").alias("check_name"))
    return absent.unionByName(bare).withColumn("severity", F.lit("warning"))


def answer_findings(
    answers: DataFrame, citations: DataFrame, max_tokens: int = 0, strict: bool = False
) -> DataFrame:
    """Empty answers, answers over the token limit, and id-like citations not repeated.

    ``answers``: query_id, answer, completion_tokens; ``citations``: query_id, citation.
    """
    over = "error" if strict else "warning"
    none = F.lit(None).cast("string").alias("citation")
    local = _rows(answers, [F.col("query_id"), none], [
        ("empty_answer", "error", tx.is_blank(F.col("answer"))),
        ("token_limit", over, F.lit(max_tokens > 0) & (F.col("completion_tokens") > max_tokens)),
    ])
    ids = citations.filter(F.col("citation").startswith("src_") | F.col("citation").startswith("doc_"))
    absent = (
        ids.join(answers, "query_id")
        .filter(F.instr(F.lower("answer"), F.lower("citation")) == 0)
        .select("query_id", "citation", F.lit("citation_absent").alias("check_name"),
                F.lit("warning").alias("severity"))
    )
    return local.unionByName(absent)
