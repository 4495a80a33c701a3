"""Dense, BM25, hybrid and multi-query retrieval for many queries at once.

Shapes
------
queries   query_id, text and/or embedding [, collections array]
index     chunk_id, embedding [, collection, ...]
corpus    chunk_id, text [, collection, ...]
hits      query_id, chunk_id, score, rank
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions import text as tx
from corpuskit.operators import sparse as sp
from corpuskit.operators.ordered import top_rows
from corpuskit.operators.running import TIE_DIGITS, Running
from corpuskit.session import kept_table

# Hits up to this many rows (queries x k) are broadcast to the corpus they point into.
BROADCAST_HITS = 1_000_000


# --- dense ------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with exactly ``dims`` numbers as a matrix, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = lengths == dims
    if not good.all():
        column = column.filter(pa.array(good))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dims), np.flatnonzero(good)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return q @ x.T
    if metric == "l2":
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * (q @ x.T)
        return 1.0 / (1.0 + np.sqrt(np.maximum(square, 0.0)))
    raise ValueError(f"unknown metric: {metric}")


def _sizes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.unique(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def dense_mismatches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, dims: queries that no index vector can be compared with.

    ``dims`` is the vector's size, 0 where it is empty or null.
    """
    size = F.greatest(F.coalesce(F.size("embedding"), F.lit(0)), F.lit(0))
    known = index.select(size.alias("dims")).filter("dims > 0").distinct()
    return queries.select("query_id", size.alias("dims")).join(F.broadcast(known), "dims", "left_anti").select(
        "query_id", "dims")


# Vectors that one packed block holds at most: a task scores a block of queries against a block of the index at once.
BLOCK_ROWS = 4096


def _packed(df: DataFrame, id_: str, names: str | None, rows: int) -> DataFrame:
    """dims, ids, names, vectors: up to ``rows`` vectors of one size as one row, numbers as bytes of doubles.

    Vectors that are empty or null are left out.
    """
    fields = [T.StructField("dims", T.IntegerType()), T.StructField("ids", T.ArrayType(df.schema[id_].dataType)),
              T.StructField("vectors", T.BinaryType())]
    columns = [id_, "embedding"]
    if names is not None:
        fields.append(T.StructField("names", T.ArrayType(df.schema[names].dataType)))
        columns.append(names)
    schema = T.StructType(fields)
    arrow = pa.schema([(f.name, t.type) for f, t in zip(schema, _arrow_types(df.sparkSession, schema))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By size of the vectors: ids, names and matrices that wait for a full block.
        waiting: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, named, parts = waiting.pop(dims)[:3]
            values = [[dims], [ids], [np.concatenate(parts).tobytes()], [named]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                for dims in _sizes(some.column(1)):
                    if dims > 0:
                        matrix, good = _matrix(some.column(1), dims)
                        own = waiting.setdefault(int(dims), [[], [], [], 0])
                        own[0] += some.column(0).take(pa.array(good)).to_pylist()
                        own[1] += some.column(2).take(pa.array(good)).to_pylist() if names is not None else []
                        own[2].append(matrix)
                        own[3] += len(good)
                        if own[3] >= rows:
                            yield block(int(dims))
        for dims in list(waiting):
            yield block(dims)

    return df.select(*columns).mapInArrow(pack, schema)


def dense_topk(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    per_collection: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact nearest neighbours, best first: query_id, chunk_id, score, rank.

    ``metric``: ``cosine`` and ``dot`` similarity, or ``l2`` scored 1/(1+d).
    With ``per_collection`` the queries carry ``collections`` (an array) and the
    index a ``collection``; each query sees only its collections and gets k rows
    from each, ranked together (``collection`` is part of the result).  A query
    is compared with the index vectors of its own size; ``dense_mismatches``
    lists those that have none.

    Queries are laid out as a table of packed blocks, whatever their number; the
    driver sees none of them.  The index is packed where it is read.  Executors
    run through a grid of (partition of query blocks) x (partition of the index),
    keep the k best rows of a block's queries over all index blocks of the cell,
    and hand on k rows per query and cell.  Index rows never shuffle.
    """
    id_type = index.schema["chunk_id"].dataType
    q_type = queries.schema["query_id"].dataType
    fields = [T.StructField("query_id", q_type), T.StructField("chunk_id", id_type),
              T.StructField("score", T.DoubleType())]
    if per_collection:
        fields.insert(2, T.StructField("collection", index.schema["collection"].dataType))
    schema = T.StructType(fields)
    names = ("collections", "collection") if per_collection else (None, None)
    asked = kept_table(_packed(queries.hint("rebalance"), "query_id", names[0], block_rows), "query-blocks")
    asked = asked.select(F.struct("*", F.monotonically_increasing_id().alias("block")).alias("q"))
    searched = _packed(index, "chunk_id", names[1], block_rows).select(F.struct("*").alias("x"))
    # Blocks against blocks, each read by the executors themselves.
    grid = asked.hint("shuffle_replicate_nl").join(searched, F.col("q.dims") == F.col("x.dims"))
    local = _scan(grid, k, metric, schema, per_collection)

    if per_collection:
        kept = top_rows(local, ["query_id", "collection"], best_first(), k, "_r").drop("_r")
        window = Window.partitionBy("query_id").orderBy(*best_first())
        return kept.withColumn("rank", F.row_number().over(window))
    return top_rows(local, ["query_id"], best_first(), k)


def _arrow_types(spark, schema):
    return list(spark.createDataFrame([], schema).toArrow().schema)


def _scan(grid: DataFrame, k: int, metric: str, schema: T.StructType, per_collection: bool, step: int = 256) -> DataFrame:
    """Local top-k of every query block over the index blocks that follow it."""
    arrow_schema = pa.schema(
        [pa.field(f.name, t.type) for f, t in zip(schema, _arrow_types(grid.sparkSession, schema))])

    def matrix(block: dict) -> np.ndarray:
        found = np.frombuffer(block["vectors"]).reshape(-1, block["dims"])
        # Once per block: the cosine is the product of unit vectors.
        return _unit(found) if metric == "cosine" else found

    def results(ids: list, found: dict, targets: dict) -> Iterator[pa.RecordBatch]:
        for name, running in found.items():
            query, chunks, scores = running.rows()
            of = targets[name][query]
            cols = {"query_id": [ids[i] for i in of], "chunk_id": list(chunks), "score": scores,
                    "collection": [name] * len(chunks)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, q_mat, found, targets = None, [], None, {}, {}
        for batch in batches:
            for row in range(batch.num_rows):
                asked = batch.column(0)[row]
                if asked["block"].as_py() != last:
                    yield from results(ids, found, targets)
                    block = asked.as_py()
                    last, ids, found, targets = block["block"], block["ids"], {}, {}
                    q_mat = matrix(block)
                    for number, wanted in enumerate(block["names"] if per_collection else ()):
                        for name in set(wanted or ()):
                            targets.setdefault(name, []).append(number)
                    targets = {name: np.array(at) for name, at in targets.items()}
                    if not per_collection:
                        targets[None] = np.arange(len(ids))
                block = batch.column(1)[row].as_py()
                mat, chunks = matrix(block), np.array([*block["ids"], None], dtype=object)[:-1]
                groups = [(None, np.arange(len(chunks)))]
                if per_collection:
                    own = np.array([*block["names"], None], dtype=object)[:-1]
                    groups = [(c, np.flatnonzero(own == c)) for c in set(block["names"]) if c in targets]
                for name, at in groups:
                    of = targets[name]
                    if name not in found:
                        found[name] = Running(len(of), k)
                    some, own_ids = (mat, chunks) if name is None else (mat[at], chunks[at])
                    for first in range(0, len(of), step):
                        found[name].add(
                            _scores(q_mat[of[first:first + step]], some, "dot" if metric == "cosine" else metric), own_ids, first)
        yield from results(ids, found, targets)

    return grid.mapInArrow(scan, schema)


def best_first() -> list[Column]:
    return [F.round("score", TIE_DIGITS).desc(), F.col("chunk_id").asc()]


def dense_scores(pairs: DataFrame, left: str, right: str, metric: str = "cosine") -> DataFrame:
    """Score given vector pairs with JVM-side array functions."""
    from corpuskit.functions import vectors as vx

    a, b = F.col(left), F.col(right)
    if metric == "dot":
        score = vx.dot(a, b)
    elif metric == "cosine":
        score = vx.dot(a, b) / (vx.norm(a) * vx.norm(b))
    else:
        gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        score = 1.0 / (1.0 + vx.norm(gap))
    return pairs.withColumn("score", score)


def score_threshold(hits: DataFrame, least: float | None) -> DataFrame:
    return hits if least is None else hits.filter(F.col("score") >= least)


def metadata_filter(index: DataFrame, equals: dict) -> DataFrame:
    """Equality predicates on index columns, applied before scoring."""
    for name, value in equals.items():
        index = index.filter(F.col(name) == F.lit(value))
    return index


# --- BM25 -------------------------------------------------------------------

# The document marker: an impossible term, one per document, that carries the
# corpus statistics beside the postings.
MARK = sp.TOTAL


def bm25_index(corpus: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Postings: collection, chunk_id, doc_len, term, tf; plus one ``MARK`` row per document.

    Terms are counted where the document is read; nothing is shuffled.  A
    ``vocabulary`` (column ``term``, small enough to broadcast) drops other
    terms.  Without a ``collection`` column the corpus is the collection ``''``.
    """
    marked = F.concat(F.array(F.struct(F.lit(MARK).alias("term"), F.lit(1).alias("tf"))), F.transform(
        F.arrays_zip("terms", "tfs"), lambda x: F.struct(x["terms"].alias("term"), x["tfs"].alias("tf"))))
    postings = sp.counted(corpus).select("collection", "chunk_id", "doc_len", F.explode(marked).alias("_p")).select(
        "collection", "chunk_id", "doc_len", "_p.term", F.col("_p.tf").cast("long").alias("tf"))
    if vocabulary is not None:
        mark = vocabulary.sparkSession.range(0, 1, 1, 1).select(F.lit(MARK).alias("term"))
        keep = vocabulary.select("term").union(mark)
        postings = postings.join(F.broadcast(keep), "term", "left_semi")
    return postings


def bm25_stats(postings: DataFrame) -> DataFrame:
    """collection, n_docs, avg_len: documents and their mean length."""
    return postings.filter(F.col("term") == MARK).groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def document_frequency(postings: DataFrame) -> DataFrame:
    """collection, term, df."""
    return postings.groupBy("collection", "term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct lower-cased terms of each query."""
    return queries.select(
        "query_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term")
    )


def few_terms(queries: DataFrame, most: int = sp.BROADCAST_TERMS) -> bool:
    """Whether the queries have at most ``most`` (query, collection, term) rows together."""
    return sp.asked_terms(queries).limit(most + 1).count() <= most


def small_vocabulary(queries: DataFrame, most: int = sp.BROADCAST_TERMS) -> DataFrame | None:
    """The distinct query terms if there are few enough to broadcast, else None."""
    return query_terms(queries).select("term").distinct() if few_terms(queries, most) else None


def hit_keys(queries: DataFrame) -> list[str]:
    """What a list of hits belongs to: a query, or a query in one of its ``collections``."""
    return ["query_id", "collection"] if "collections" in queries.columns else ["query_id"]


def bm25_scores(
    queries: DataFrame,
    corpus: DataFrame | None,
    k1: float = 1.2,
    b: float = 0.75,
    postings: DataFrame | None = None,
) -> DataFrame:
    """Scores of all matching (query, chunk) pairs: query_id [, collection], chunk_id, score.

    idf = ln((N - df + 0.5) / (df + 0.5) + 1); query terms count once.  With
    ``collections`` (an array) a query is asked of each of them for itself: N, df
    and mean length are the collection's.  Pass ``postings`` to reuse an index.
    """
    few = few_terms(queries)
    if postings is None:
        vocabulary = query_terms(queries).select("term").distinct() if few else None
        postings = bm25_index(corpus, vocabulary)
    if "collections" not in queries.columns:
        postings = postings.withColumn("collection", F.lit(""))
    weighted = (
        sp.asked_terms(queries)
        .join(document_frequency(postings), ["collection", "term"])
        .join(bm25_stats(postings), "collection")
        .select("query_id", "collection", "term", "avg_len",
                sp.inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf"))
    )
    # Left to estimates, Spark may broadcast the postings instead.
    weighted = F.broadcast(weighted) if few else weighted
    part = F.col("idf") * sp.saturation(F.col("tf"), F.col("doc_len"), F.col("avg_len"), k1, b)
    return (
        postings.join(weighted, ["collection", "term"])
        .groupBy(*hit_keys(queries), "chunk_id")
        .agg(F.sum(part).alias("score"))
    )


def bm25_topk(
    queries: DataFrame,
    corpus: DataFrame | None,
    k: int = 10,
    k1: float = 1.2,
    b: float = 0.75,
    postings: DataFrame | None = None,
) -> DataFrame:
    """The k best of each query, or of each query in each of its ``collections``.

    The corpus is read once; what it holds of the queries' terms is stored for
    statistics and scores, and each task hands on k rows per query; with too many query terms to broadcast, or
    with ``postings``, scores come from joins instead.
    """
    keys = hit_keys(queries)
    asked = sp.weights(queries, _scoped(queries, corpus)) if postings is None else None
    if asked is None:
        return top_rows(bm25_scores(queries, corpus, k1, b, postings), keys, best_first(), k)
    asked, counts = asked
    found = sp.scan(counts, asked, queries.schema["query_id"].dataType, k, k1, b)
    return top_rows(found.filter(F.col("chunk_id").isNotNull()).select(*keys, "chunk_id", "score"), keys, best_first(), k)


def _scoped(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """The corpus with its collections only where the queries name some."""
    return corpus if "collections" in queries.columns else corpus.select("chunk_id", "text")


def small_side(df: DataFrame, most_rows: int | None) -> DataFrame:
    """Mark ``df`` for broadcast if the caller can prove it has few rows
    (number of queries times k); otherwise leave the join to Spark."""
    return F.broadcast(df) if most_rows is not None and most_rows <= BROADCAST_HITS else df


def attach_content(hits: DataFrame, corpus: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Corpus columns onto hits.  A provably short hit list goes to the corpus,
    so that no text is shuffled."""
    return corpus.join(small_side(hits, most_rows), "chunk_id")


# --- fusion -----------------------------------------------------------------

FLAT_RANGE = 1e-9  # fixed value: score ranges below this count as constant


def score_bounds(hits: DataFrame, corpus_size: Column | None = None, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """query_id, _lo, _hi: the range of a query's scores, pre-aggregated map-side."""
    low = F.min("score")
    if corpus_size is not None:
        low = F.when(F.count(F.lit(1)) < corpus_size, F.least(low, F.lit(0.0))).otherwise(low)
    return hits.groupBy(*keys).agg(low.alias("_lo"), F.max("score").alias("_hi"))


def _scaled(low: Column, high: Column, constant_value: float) -> Column:
    return F.when(high - low < FLAT_RANGE, F.lit(constant_value)).otherwise((F.col("score") - low) / (high - low))


def minmax_normalise(
    hits: DataFrame,
    corpus_size: Column | None = None,
    constant_value: float = 1.0,
    bounds: DataFrame | None = None,
    keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Scale scores to [0, 1] per query; a constant list gets ``constant_value``.

    ``corpus_size`` says how many rows each query has in truth: when some of
    them are absent from ``hits`` because they score zero, zero is the minimum.
    Bounds are pre-aggregated per query, not taken from a window.
    """
    if bounds is None:
        bounds = score_bounds(hits, corpus_size, keys)
    return hits.join(bounds, list(keys)).withColumn(
        "score", _scaled(F.col("_lo"), F.col("_hi"), constant_value)).drop("_lo", "_hi")


def bm25_normalised(
    queries: DataFrame, corpus: DataFrame, k: int | None = 10, also: DataFrame | None = None, constant_value: float = 1.0,
    k1: float = 1.2, b: float = 0.75,
) -> DataFrame:
    """The k best and those in ``also``, scaled by the range of all scores of the query; others may be listed, too.

    With ``k`` None all chunks that match a term are listed.

    Rows that match no term score zero before scaling, so zero is the minimum
    where there are such.  ``also`` has query_id [, collection] and chunk_id.  One
    pass over the corpus finds scores and ranges; where terms or ``also`` are too
    many to broadcast, joins do.
    """
    keys, corpus = hit_keys(queries), _scoped(queries, corpus)
    many = also is not None and also.limit(BROADCAST_HITS + 1).count() > BROADCAST_HITS
    asked = None if many else sp.weights(queries, corpus)
    if asked is None:
        raw = bm25_scores(queries, corpus, k1, b)
        stats = bm25_stats(bm25_index(corpus)).select("collection", "n_docs")
        found = raw.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count("*").alias("_n"))
        found = found.withColumn("_of", F.col("collection") if len(keys) > 1 else F.lit("")).join(
            stats.withColumnRenamed("collection", "_of"), "_of")
        bounds = found.select(*keys, F.when(F.col("_n") < F.col("n_docs"), F.least("_lo", F.lit(0.0))).otherwise(
            F.col("_lo")).alias("_lo"), "_hi")
        if k is None:
            return minmax_normalise(raw, constant_value=constant_value, bounds=bounds, keys=tuple(keys))
        mark = F.lit(0).alias("_also")
        if also is not None:
            raw = raw.join(also.select(*keys, "chunk_id", F.lit(1).alias("_also")), [*keys, "chunk_id"], "left")
            mark = F.col("_also")
        size = k + (0 if also is None else also.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        best = top_rows(raw.withColumn("_also", mark), keys, [F.col("_also").desc_nulls_last(), *best_first()], size, "_r")
        return minmax_normalise(best.select(*keys, "chunk_id", "score"), constant_value=constant_value, bounds=bounds,
                                keys=tuple(keys))
    asked, counts = asked
    query_type, wanted = queries.schema["query_id"].dataType, {}
    if also is not None and k is not None:
        numbers = {name: {_hashable(q): i for i, q in enumerate(own.names)} for name, own in asked.items()}
        for row in also.select("query_id", "chunk_id", *keys[1:]).toArrow().to_pylist():
            name = row.get("collection", "")
            number = numbers.get(name, {}).get(_hashable(row["query_id"]))
            if number is not None:
                wanted.setdefault(name, {}).setdefault(row["chunk_id"], []).append(number)
    rows = sp.scan(counts, asked, query_type, 1 if k is None else k, k1, b, wanted)
    sizes = F.broadcast(corpus.sparkSession.createDataFrame(
        [(name, own.n_docs) for name, own in asked.items()], "collection string, _docs long"))
    if k is None:
        # One row per query; all scores are scaled where they are found.
        ranges = rows.filter(F.col("chunk_id").isNull()).groupBy("query_id", "collection").agg(
            F.max("score").alias("_hi"), F.min("low").alias("_low"), F.sum("n").alias("_n")).join(sizes, "collection")
        ranges = ranges.select("query_id", "collection", "_hi", F.when(
            F.col("_n") < F.col("_docs"), F.least("_low", F.lit(0.0))).otherwise(F.col("_low")).alias("_lo"))
        return sp.scan(counts, asked, query_type, None, k1, b).join(
            F.broadcast(ranges), ["query_id", "collection"]).withColumn(
            "score", _scaled(F.col("_lo"), F.col("_hi"), constant_value)).select(*keys, "chunk_id", "score")
    whole = Window.partitionBy(*keys)
    low, n = F.min("low").over(whole), F.sum("n").over(whole)
    rows = rows.join(sizes, "collection").withColumns({
        "_hi": F.max("score").over(whole),
        "_lo": F.when(n < F.col("_docs"), F.least(low, F.lit(0.0))).otherwise(low)})
    return rows.filter(F.col("chunk_id").isNotNull()).withColumn(
        "score", _scaled(F.col("_lo"), F.col("_hi"), constant_value)).select(
        *keys, "chunk_id", "score").dropDuplicates([*keys, "chunk_id"])


def _hashable(query_id):
    return tuple(query_id.items()) if isinstance(query_id, dict) else query_id


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {name: w / total for name, w in weights.items()}


def weighted_fusion(
    dense: DataFrame, sparse: DataFrame, weights: dict[str, float] | None = None, keys: tuple[str, ...] = ("query_id",),
) -> DataFrame:
    """Weighted sum of two score lists on (query, chunk); a missing side adds 0."""
    w = normalised_weights(weights or {"dense": 0.5, "sparse": 0.5})
    names = [*keys, "chunk_id"]
    return (
        dense.select(*names, F.col("score").alias("_d"))
        .join(sparse.select(*names, F.col("score").alias("_s")), names, "full_outer")
        .select(
            *names,
            (F.coalesce("_d", F.lit(0.0)) * w["dense"]
             + F.coalesce("_s", F.lit(0.0)) * w["sparse"]).alias("score"),
        )
    )


def hybrid_topk(
    queries: DataFrame,
    index: DataFrame,
    corpus: DataFrame,
    k: int = 10,
    weights: dict[str, float] | None = None,
    threshold: float | None = None,
    metric: str = "cosine",
    constant_value: float = 1.0,
    k1: float = 1.2,
    b: float = 0.75,
) -> DataFrame:
    """Dense and BM25 fused: 2k dense rows, BM25 over the whole corpus.

    ``queries`` carries text and embedding.  With ``collections`` (an array) each
    query is answered in each of them for itself: k rows, ranks and both scores'
    ranges are the collection's, index and corpus carry ``collection``.  Chunks
    without any signal score 0 and are not listed.  For a query whose terms match
    nothing, every chunk has the same BM25 score and so gets ``constant_value``;
    it is added to the dense rows, which lead the ranking in that case.

    What can reach the result are the dense rows and the k best by BM25; the pass
    over the corpus that finds these scores the dense rows, too.
    """
    keys = tuple(hit_keys(queries))
    dense = dense_topk(queries, index, 2 * k, metric, per_collection=len(keys) > 1)
    # Kept, for two readers: 2k short rows for each query.
    dense = kept_table(minmax_normalise(dense.drop("rank"), constant_value=constant_value, keys=keys), "dense")
    sparse = bm25_normalised(queries, corpus, k, dense, constant_value, k1, b)
    unmatched = dense.join(sparse.select(*keys).distinct(), list(keys), "left_anti").withColumn(
        "score", F.lit(constant_value))
    fused = weighted_fusion(dense, sparse.unionByName(unmatched.select(*sparse.columns)), weights, keys)
    return score_threshold(top_rows(fused, keys, best_first(), k), threshold)


# --- query expansion --------------------------------------------------------

# fixed values: word swaps of the synonym variant
SYNONYMS = {
    "find": "search",
    "get": "retrieve",
    "show": "list",
    "how": "what",
    "document": "file",
    "report": "analysis",
    "create": "make",
    "change": "modify",
    "delete": "remove",
    "error": "issue",
}


def expand_queries(queries: DataFrame, num_variants: int = 3) -> DataFrame:
    """query_id, variant (0 = original), text.

    Variants, in order and only where they differ from the query: every other
    word (over 3 words), first and last word (over 2), synonyms swapped.
    """
    query = tx.strip(F.col("text"))
    tokens = tx.words(query)
    swaps = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    short = F.when(
        F.size(tokens) > 3,
        F.array_join(F.filter(tokens, lambda t, i: i % 2 == 0), " "))
    ends = F.when(
        F.size(tokens) > 2,
        F.concat_ws(" ", F.element_at(tokens, 1), F.element_at(tokens, -1)))
    swapped = F.array_join(F.transform(tokens, lambda t: F.coalesce(swaps[t], t)), " ")
    variants = F.array_compact(F.array(
        F.col("text"), short, F.nullif(ends, query), F.nullif(swapped, query)))
    return queries.filter(~tx.is_blank(F.col("text"))).select(
        "query_id", F.posexplode(F.slice(variants, 1, num_variants)).alias("variant", "text"))


def merge_variant_hits(
    hits: DataFrame, k: int = 10, threshold: float | None = None
) -> DataFrame:
    """Best score per (query, chunk) over the variants, then top-k."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_rows(score_threshold(best, threshold), ["query_id"], best_first(), k)


def multi_query_topk(
    queries: DataFrame, corpus: DataFrame | None, k: int = 10, num_variants: int = 3,
    threshold: float | None = None, retrieve: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """Expand, retrieve k per variant, merge.

    ``retrieve`` takes the variants (query_id, text; query_id is a struct of
    query_id and variant) and k, and returns hits with query_id, chunk_id and
    score; without it BM25 over ``corpus`` is asked.
    """
    variants = expand_queries(queries, num_variants).select(
        F.struct("query_id", "variant").alias("query_id"), "text")
    hits = bm25_topk(variants, corpus, k) if retrieve is None else retrieve(variants, k)
    return merge_variant_hits(
        hits.select(F.col("query_id.query_id").alias("query_id"), "chunk_id", "score"),
        k, threshold)


def bm25_fill(
    dense: DataFrame, sparse_scores: DataFrame, n: int = 5, scope: tuple[str, ...] = ("query_id",),
    *, most_dense: int,
) -> DataFrame:
    """Append, with score 0, the ``n`` best BM25 chunks the dense hits lack.

    ``scope`` is ("query_id",) or ("query_id", "collection"): where n counts; with
    collections both sides carry theirs.  ``most_dense``: the largest number of
    dense hits in a scope (its k).  The n best missing chunks are then among the
    n + most_dense best, and only those take part in the join.
    """
    names = [*scope, "chunk_id"]
    best = top_rows(sparse_scores, list(scope), best_first(), n + most_dense, "_r").drop("_r")
    missing = best.join(dense.select(*names), names, "left_anti")
    added = top_rows(missing, list(scope), best_first(), n, "_r")
    origin = dense.select(*names, "score", F.lit("dense").alias("origin"))
    return origin.unionByName(added.select(*names, F.lit(0.0).alias("score"), F.lit("bm25").alias("origin")))


def search_owned(
    requests: DataFrame, owned: DataFrame, index: DataFrame, k: int = 25, metric: str = "cosine"
) -> DataFrame:
    """Dense search limited to collections the asking user owns.

    ``requests``: query_id, user_id, collection, embedding;
    ``owned``: user_id, collection.
    """
    allowed = requests.join(owned, ["user_id", "collection"], "left_semi")
    queries = allowed.select(
        "query_id", "embedding", F.array("collection").alias("collections"))
    return dense_topk(queries, index, k, metric, per_collection=True)
