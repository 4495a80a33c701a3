"""Second-stage ordering of retrieved rows (k rows per query)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions import text as tx
from corpuskit.operators.retrieval import TIE_DIGITS

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]


def identity(hits: DataFrame) -> DataFrame:
    return hits


def rank_scores(hits: DataFrame) -> DataFrame:
    """Score 1 - i/n by rank; the given score moves to ``original_score``."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return hits.withColumn("original_score", F.col("score")).withColumn(
        "score", 1.0 - (F.col("rank") - 1) / n)


def rerank_pairwise(hits: DataFrame, queries: DataFrame, scorer: Callable[[], Scorer]) -> DataFrame:
    """Score (query text, content) pairs with a user model and re-rank.

    ``scorer()`` is called once per task and returns a function of two equally
    long text lists.  A batch it fails on keeps its scores and order.
    """

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = scorer()
        for asked, content in batches:
            try:
                yield pd.Series([float(s) for s in score(asked.tolist(), content.tolist())])
            except Exception:  # noqa: BLE001 - the candidates stay as they are
                yield pd.Series([None] * len(asked), dtype="float64")

    pairs = hits.join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    scored = pairs.withColumn("_new", F.round(run("_query", "content"), TIE_DIGITS)).drop("_query")
    failed = F.max(F.col("_new").isNull()).over(Window.partitionBy("query_id"))
    order = Window.partitionBy("query_id").orderBy(
        F.when(F.col("_failed"), F.lit(None)).otherwise(F.col("_new")).desc(), F.col("rank").asc())
    return (
        scored.withColumn("_failed", failed)
        .withColumn("rank", F.row_number().over(order))
        .withColumn("score", F.when(F.col("_failed"), F.col("score")).otherwise(F.col("_new")))
        .drop("_new", "_failed")
    )


def overlap_scorer() -> Scorer:
    """Share of distinct query words found in the content."""

    def score(asked: Sequence[str], content: Sequence[str]) -> list[float]:
        out = []
        for q, c in zip(asked, content):
            want = set(q.lower().split())
            out.append(len(want & set(c.lower().split())) / len(want) if want else 0.0)
        return out

    return score


class Overlap:
    """Word overlap (Jaccard) of one candidate with all: an array of word numbers and their owners."""

    def __init__(self, words: Sequence[Sequence[str]]) -> None:
        number: dict[str, int] = {}
        self.words = [np.array([number.setdefault(w, len(number)) for w in own], np.int64) for own in words]
        self.sizes = np.array([len(w) for w in self.words])
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.words)), self.sizes)
        self.marked = np.zeros(len(number), dtype=bool)

    def to(self, pick: int) -> np.ndarray:
        self.marked[self.words[pick]] = True
        shared = np.bincount(self.owner, weights=self.marked[self.flat], minlength=len(self.sizes))
        self.marked[self.words[pick]] = False
        union = self.sizes + self.sizes[pick] - shared
        return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def mmr(
    hits: DataFrame, lambda_: float = 0.7, k: int = 5,
    similarity: Callable[[object, object], float] | None = None, feature: str | None = None,
) -> DataFrame:
    """Maximal marginal relevance: query_id, chunk_id, rank, score, original_score.

    The first candidate (rank 1) is taken as given; each further pick maximises
    lambda * score - (1 - lambda) * (largest similarity to a pick), ties to the
    earlier candidate.  Similarity defaults to word overlap of ``content``;
    ``similarity`` compares values of the column ``feature`` instead.  A pick
    costs one pass over the candidates' words, however many there are.
    """
    value = F.array_distinct(tx.terms(F.col("content"))) if feature is None else F.col(feature)
    as_set = feature is None
    ids = {f.name: f.dataType for f in hits.schema.fields}
    schema = T.StructType([
        T.StructField("query_id", ids["query_id"]), T.StructField("chunk_id", ids["chunk_id"]),
        T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()),
        T.StructField("original_score", T.DoubleType()),
    ])

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        values = group["value"].tolist()
        overlap = Overlap(values) if as_set else None
        relevance = group["score"].to_numpy(dtype=float)
        closest, left = np.zeros(len(group)), np.ones(len(group), dtype=bool)
        limit = min(k, len(group)) if k > 0 else len(group)
        picks: list[int] = []
        while len(picks) < limit:
            at = 0
            if picks:
                last = picks[-1]
                near = overlap.to(last) if as_set else np.array(
                    [similarity(v, values[last]) if left[i] else 0.0 for i, v in enumerate(values)])
                closest = np.maximum(closest, near)
                gain = np.round(lambda_ * relevance - (1 - lambda_) * closest, TIE_DIGITS)
                at = int(np.argmax(np.where(left, gain, -np.inf)))
            left[at] = False
            picks.append(at)
        out = group.iloc[picks][["query_id", "chunk_id", "score"]].rename(columns={"score": "original_score"})
        out["rank"] = range(1, len(picks) + 1)
        # A lone candidate is returned as it came.
        out["score"] = out["original_score"] if len(group) == 1 else [
            1.0 - i / len(picks) for i in range(len(picks))]
        return out[[f.name for f in schema]]

    narrow = hits.select("query_id", "chunk_id", "score", "rank", value.alias("value"))
    return narrow.groupBy("query_id").applyInPandas(choose, schema)
