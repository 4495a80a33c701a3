"""Request traces: stage timings per request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordered import rank_select

# fixed values: the stages and counts of a trace
STAGES = (
    "rewrite", "embed", "vector_search", "bm25", "cross_encoder", "mmr", "context", "prompt_build",
    "llm", "save", "total",
)
COUNTS = ("chunks_retrieved", "chunks_cited", "prompt_tokens", "completion_tokens")


def fold_stages(wide: DataFrame, stages: Sequence[str] = STAGES, suffix: str = "_ms", out: str = "stages") -> DataFrame:
    """Columns ``<stage><suffix>`` to one map column."""
    columns = [f"{s}{suffix}" for s in stages]
    pairs = F.map_from_arrays(F.array(*[F.lit(s) for s in stages]), F.array(*[F.col(c) for c in columns]))
    return wide.withColumn(out, pairs).drop(*columns)


def unfold_stages(folded: DataFrame, stages: Sequence[str] = STAGES, suffix: str = "_ms", column: str = "stages") -> DataFrame:
    """The map back to columns; a missing stage took no time."""
    return folded.select(
        *[c for c in folded.columns if c != column],
        *[F.coalesce(F.col(column)[s], F.lit(0.0)).alias(f"{s}{suffix}") for s in stages])


def stage_rows(folded: DataFrame, column: str = "stages") -> DataFrame:
    """One row per request and stage: stage, ms."""
    return folded.select(*[c for c in folded.columns if c != column], F.explode(column).alias("stage", "ms"))


def recent(traces: DataFrame, n: int) -> DataFrame:
    return traces.orderBy(F.col("created_at").desc(), F.col("request_id").desc()).limit(n)


def stage_latency(rows: DataFrame, keys: Sequence[str] = ("prompt_version", "model", "provider")) -> DataFrame:
    """Per keys and stage: n, mean, exact median and p95 (element floor(0.95 n)),
    and the stage's share of the keys' total time."""
    keys = list(keys)
    n = F.col("n")
    order = rank_select(rows, [*keys, "stage"], "ms", {
        "_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2), "p95_ms": F.floor(n * 0.95)})
    # Keys as structs, because a null key is a group, too.
    all_, each = F.struct(*keys).alias("_all"), F.struct(*keys, "stage").alias("_each")
    sums = rows.groupBy(all_, each).agg(F.avg("ms").alias("mean_ms"), F.sum("ms").alias("_sum"))
    totals = sums.groupBy("_all").agg(F.sum("_sum").alias("_total"))
    return (
        order.withColumn("_each", each).join(sums, "_each").join(totals, "_all")
        .select(*keys, "stage", "n", "mean_ms", ((F.col("_low") + F.col("_high")) / 2).alias("p50_ms"), "p95_ms",
                (F.col("_sum") / F.nullif(F.col("_total"), F.lit(0.0))).alias("share")))


def stage_rollup(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean time and counts at every level of the key hierarchy (null = all)."""
    return rows.rollup(*keys).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))


def usage(traces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cache hit rate, tokens, and chunks cited per chunk retrieved."""
    count = lambda name: F.coalesce(F.col("counts")[name], F.lit(0))
    return traces.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"),
        F.sum(count("prompt_tokens")).alias("prompt_tokens"),
        F.sum(count("completion_tokens")).alias("completion_tokens"),
        F.sum(count("chunks_retrieved")).alias("chunks_retrieved"),
        F.sum(count("chunks_cited")).alias("chunks_cited"),
    ).withColumn("cited_share", F.coalesce(
        F.col("chunks_cited") / F.nullif(F.col("chunks_retrieved"), F.lit(0)), F.lit(0.0)))


def windows(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling windows: window_start, n, errors, mean_ms, max_ms.  Works on streams too.

    ``rows``: ts, ms, failed.
    """
    return rows.groupBy(F.window("ts", width).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("errors"),
        F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"),
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
             "n", "errors", "mean_ms", "max_ms")
