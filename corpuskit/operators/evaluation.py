"""Ranking quality and run scorecards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators.ordered import rank_select


def _gain(rank: Column) -> Column:
    return 1.0 / F.log2(rank + 1.0)


def _ideal(n: Column) -> Column:
    """Sum of the first ``n`` discounts; n is at most the list length."""
    ranks = F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + _gain(r))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def grade_hits(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """Add ``grade``: 1 when (query, chunk) is listed in ``relevant``."""
    marks = relevant.select("query_id", "chunk_id").distinct().withColumn("_rel", F.lit(1))
    return hits.join(marks, ["query_id", "chunk_id"], "left").withColumn(
        "grade", F.coalesce("_rel", F.lit(0))).drop("_rel")


def ranking_metrics(graded: DataFrame, n_relevant: DataFrame, ks: Sequence[int] = (5, 10)) -> DataFrame:
    """Recall, MRR and nDCG at each k per query.

    ``graded``: query_id, rank, grade (0/1).  ``n_relevant``: query_id and the
    number of relevant items.  The ideal ranking sorts all *retrieved* grades.
    A query without relevant items scores 0.
    """
    aggs = [F.sum("grade").alias("_all")]
    for k in ks:
        hit = (F.col("rank") <= k) & (F.col("grade") > 0)
        aggs += [
            F.count(F.when(hit, 1)).alias(f"_found_{k}"),
            F.min(F.when(hit, F.col("rank"))).alias(f"_first_{k}"),
            F.sum(F.when(hit, _gain(F.col("rank"))).otherwise(0.0)).alias(f"_dcg_{k}"),
        ]
    per_query = n_relevant.join(graded.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = [F.col("query_id")]
    for k in ks:
        ideal = _ideal(F.least(F.coalesce("_all", F.lit(0)), F.lit(k)))
        out += [
            _ratio(F.coalesce(f"_found_{k}", F.lit(0)), F.col("n_relevant")).alias(f"recall_at_{k}"),
            F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0)).alias(f"mrr_at_{k}"),
            _ratio(F.coalesce(f"_dcg_{k}", F.lit(0.0)), ideal).alias(f"ndcg_at_{k}"),
        ]
    return per_query.select(*out)


def benchmark_metrics(graded: DataFrame, k: int = 10) -> DataFrame:
    """Per query: recall and precision over the retrieved rows, hit rate, MRR, nDCG."""
    inside = F.col("rank") <= k
    hit = inside & (F.col("grade") > 0)
    per_query = graded.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(hit, 1)).alias("_found"),
        F.min(F.when(hit, F.col("rank"))).alias("_first"),
        F.sum(F.when(hit, _gain(F.col("rank"))).otherwise(0.0)).alias("_dcg"),
    )
    return per_query.select(
        "query_id",
        (F.col("_found") / F.col("_n")).alias("recall"),
        (F.col("_found") / F.least(F.col("_n"), F.lit(k))).alias("precision"),
        (F.col("_found") > 0).cast("double").alias("hit_rate"),
        F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"),
        _ratio(F.col("_dcg"), _ideal(F.col("_found"))).alias("ndcg"),
    )


def mean_metrics(per_query: DataFrame, names: Sequence[str]) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("num_queries"), *[F.avg(n).alias(n) for n in names])


def citation_precision(citations: DataFrame) -> DataFrame:
    """Share of citations with a chunk id and a score above 0.01, per query."""
    usable = (F.coalesce(F.col("chunk_id").cast("string"), F.lit("")) != "") & (F.col("score") > 0.01)
    return citations.groupBy("query_id").agg(
        F.avg(F.when(usable, 1.0).otherwise(0.0)).alias("citation_precision"))


def judge_score(c: Column) -> Column:
    """YES -> 1, NO -> 0, else the first number in the text, held to [0, 1]."""
    answer = F.upper(tx.strip(c))
    number = F.regexp_extract(answer, r"([01]\.?\d*)", 1).try_cast("double")
    return (
        F.when(answer.startswith("YES"), 1.0)
        .when(answer.startswith("NO"), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(number, F.lit(0.0)))))
    )


def eval_scorecard(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Means, latency median and p95 (element at floor(0.95 n)), overall 0-10.

    ``results``: run keys, faithfulness, relevance, citation_precision, latency_ms.
    """
    keys = list(keys)
    n = F.col("n")
    order = rank_select(
        results, keys, "latency_ms",
        {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2), "latency_p95": F.floor(n * 0.95)},
    )
    means = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_queries"),
        F.avg("faithfulness").alias("faithfulness"),
        F.avg("relevance").alias("relevance"),
        F.avg("citation_precision").alias("citation_precision"),
    )
    return means.join(order, keys).select(
        *keys, "num_queries", "faithfulness", "relevance", "citation_precision",
        ((F.col("_low") + F.col("_high")) / 2).alias("latency_p50"), "latency_p95",
        ((F.col("faithfulness") + F.col("relevance") + F.col("citation_precision")) / 3 * 10)
        .alias("overall"),
    )


def compare_runs(runs: DataFrame, config: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` runs per configuration, with the change to the run before."""
    window = Window.partitionBy(*config).orderBy(F.col("created_at").desc(), F.col("run_id").desc())
    newest = runs.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= n + 1)
    return (
        newest.withColumn("overall_delta", F.col("overall") - F.lead("overall").over(window))
        .filter(F.col("_r") <= n)
        .withColumnRenamed("_r", "recency")
    )


def topic_coverage(retrieved: DataFrame, topics: DataFrame) -> DataFrame:
    """Share of expected topics found in a query's retrieved texts.

    ``retrieved``: query_id, content; ``topics``: query_id, topics array.
    """
    wanted = topics.select("query_id", F.explode(F.array_distinct("topics")).alias("topic"))
    seen = (
        retrieved.join(wanted, "query_id")
        .filter(F.instr(F.lower("content"), F.lower(F.col("topic"))) > 0)
        .select("query_id", "topic").distinct()
        .withColumn("_seen", F.lit(1))
    )
    return (
        wanted.join(seen, ["query_id", "topic"], "left")
        .groupBy("query_id")
        .agg(F.avg(F.coalesce("_seen", F.lit(0))).alias("topic_coverage"))
    )


def latency_summary(timings: DataFrame, keys: Sequence[str] = ("operation",), value: str = "ms") -> DataFrame:
    return timings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean_ms"),
        F.stddev_samp(value).alias("stddev_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        (F.count(F.lit(1)) / F.nullif(F.sum(value) / 1000.0, F.lit(0.0))).alias("per_second"),
    )
