"""Questions to prompts and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import citations as ct
from corpuskit.operators import context as cx
from corpuskit.operators import reranking as rr
from corpuskit.operators import retrieval as rt

STRATEGIES = {
    "single_document": (cx.assemble_single, cx.single_prompt),
    "multi_document": (cx.assemble_multi, cx.multi_prompt),
    "comparison": (cx.assemble_comparison, cx.comparison_prompt),
}


def retrieve(
    queries: DataFrame, index: DataFrame, corpus: DataFrame, k: int = 25, fill: int = 5,
    lambda_: float = 0.4, keep: int = 4,
) -> DataFrame:
    """Dense hits, BM25 fill and MMR.

    ``queries``: query_id, text, embedding; ``corpus``: chunk_id, text and
    whatever the context needs.  Gives hits with content, ranked.
    """
    dense = rt.dense_topk(queries, index, k)
    sparse = rt.bm25_topk(queries.select("query_id", "text"), corpus.select("chunk_id", "text"), fill + k)
    merged = rt.bm25_fill(dense, sparse, fill, most_dense=k).drop("origin")
    ranked = rt.top_rows(merged, ["query_id"], rt.best_first(), k + fill)
    content = corpus.withColumnRenamed("text", "content")
    n = queries.count()
    candidates = rt.attach_content(ranked, content, n * (k + fill))
    picked = rr.mmr(candidates, lambda_, keep)
    return rt.attach_content(picked, content, n * keep).withColumn("pos", F.col("rank"))


def prompts(hits: DataFrame, queries: DataFrame, strategy: str = "single_document") -> tuple[DataFrame, DataFrame]:
    """(prompt rows, citation rows) from retrieved hits with the context columns."""
    assemble, system = STRATEGIES[strategy]
    rows = assemble(cx.select_context(hits))
    budgets = cx.allocate_budget(rows, queries)
    fitted = cx.enforce_budget(rows, budgets)
    asked = queries.select("query_id", "text").join(system(rows), "query_id")
    return ct.render_prompts(fitted, asked, strategy), ct.extract_citations(fitted)
