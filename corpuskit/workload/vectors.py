"""Vector search, vector checks, vector tables, ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import vectors as vx
from corpuskit.operators import collections as col
from corpuskit.operators import embedding as emb
from corpuskit.operators import evaluation as ev
from corpuskit.operators import quality as ql
from corpuskit.operators import retrieval as rt
from corpuskit.session import fresh_path, kept_table
from corpuskit.sources.table import StoredTable
from corpuskit.workload.common import Book, Tables

BOOK = Book()

# --- dense search -----------------------------------------------------------

_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_L2 = "1/(1+list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))"


def _knn_sql(score: str, k: int, where: str = "") -> str:
    return f"""
      knn AS (
        SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, a.label AS query_label,
               b.label AS collection, round({score}, 9) AS score
        FROM embeddings a CROSS JOIN embeddings b {where}),
      hits AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM knn QUALIFY rank <= {k})"""


for _name, _metric, _score in (("dense_topk_cosine", "cosine", _COS), ("dense_topk_l2", "l2", _L2)):

    @BOOK.add(_name, f"""
      WITH {_knn_sql(_score, 10)}
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
    def _dense(t: Tables, metric: str = _metric) -> DataFrame:
        return rt.dense_topk(t.vector_queries(), t.vector_index(), 10, metric)


_MIXED = """
      mixed AS (
        SELECT vec_id, label, CASE WHEN vec_id % 50 = 3 THEN embedding[:7] WHEN vec_id % 5 = 0 THEN embedding[:16]
          ELSE embedding END AS q,
          CASE WHEN vec_id % 4 = 0 THEN embedding[:16] ELSE embedding END AS x FROM embeddings)"""


def _mixed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Queries of three vector sizes and an index of two."""
    v, e = F.col("vec_id"), F.col("embedding")
    queries = t.embeddings.select(v.alias("query_id"), F.when(v % 50 == 3, F.slice(e, 1, 7)).when(
        v % 5 == 0, F.slice(e, 1, 16)).otherwise(e).alias("embedding"))
    index = t.embeddings.select(
        v.alias("chunk_id"), F.when(v % 4 == 0, F.slice(e, 1, 16)).otherwise(e).alias("embedding"))
    return queries, index


@BOOK.add("dense_mixed_sizes", f"""
      WITH {_MIXED}
      SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
        round(list_cosine_similarity(a.q::DOUBLE[], b.x::DOUBLE[]), 6) AS score,
        row_number() OVER (PARTITION BY a.vec_id
          ORDER BY round(list_cosine_similarity(a.q::DOUBLE[], b.x::DOUBLE[]), 9) DESC, b.vec_id) AS rank
      FROM mixed a JOIN mixed b ON len(a.q) = len(b.x) QUALIFY rank <= 6""")
def dense_mixed_sizes(t: Tables) -> DataFrame:
    """Every query against the vectors of its size; odd ones leave the others alone."""
    return rt.dense_topk(*_mixed(t), 6)


@BOOK.add("dense_mismatches", f"""
      WITH {_MIXED}
      SELECT vec_id AS query_id, len(q) AS dims FROM mixed WHERE len(q) NOT IN (SELECT len(x) FROM mixed)""")
def dense_mismatches(t: Tables) -> DataFrame:
    return rt.dense_mismatches(*_mixed(t))


@BOOK.add("dense_threshold", f"""
      WITH {_knn_sql(_COS, 10)}
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits WHERE score >= 0.3""")
def dense_threshold(t: Tables) -> DataFrame:
    return rt.score_threshold(rt.dense_topk(t.vector_queries(), t.vector_index(), 10), 0.3)


@BOOK.add("dense_metadata_filter", f"""
      WITH {_knn_sql(_COS, 10, "WHERE b.label = 3")}
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
def dense_metadata_filter(t: Tables) -> DataFrame:
    index = rt.metadata_filter(t.vector_index(), {"collection": 3})
    return rt.dense_topk(t.vector_queries(), index, 10)


@BOOK.add("dense_per_collection", f"""
      WITH knn AS (
        SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label AS collection,
               round({_COS}, 9) AS score
        FROM embeddings a JOIN embeddings b
          ON b.label = a.label OR b.label = (a.label + 1) % 10),
      kept AS (
        SELECT * FROM knn QUALIFY
          row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, chunk_id) <= 5)
      SELECT query_id, chunk_id, collection::BIGINT AS collection, round(score, 6) AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM kept""")
def dense_per_collection(t: Tables) -> DataFrame:
    queries = t.vector_queries().withColumn(
        "collections", F.array("label", (F.col("label") + 1) % 10))
    return rt.dense_topk(queries, t.vector_index(), 5, per_collection=True)


@BOOK.add("search_owned", f"""
      WITH knn AS (
        SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label AS collection,
               round({_COS}, 9) AS score
        FROM embeddings a JOIN embeddings b ON b.label = a.label
        WHERE EXISTS (SELECT 1 FROM nation n
                      WHERE n.n_nationkey = b.label AND n.n_regionkey = a.vec_id % 5))
      SELECT query_id, chunk_id, collection::BIGINT AS collection, round(score, 6) AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM knn QUALIFY rank <= 25""")
def search_owned(t: Tables) -> DataFrame:
    requests = t.vector_queries().select(
        "query_id", "embedding", F.col("label").alias("collection"),
        (F.col("query_id") % 5).alias("user_id"))
    owned = t.nation.select(
        F.col("n_regionkey").cast("bigint").alias("user_id"), F.col("n_nationkey").alias("collection"))
    return rt.search_owned(requests, owned, t.vector_index(), 25)


# Score transforms on given pairs: each vector against its label's smallest id.
@BOOK.add("score_transforms", """
      WITH heads AS (SELECT label, arg_min(embedding, vec_id) AS head FROM embeddings GROUP BY label),
      p AS (SELECT vec_id, embedding::DOUBLE[] AS a, head::DOUBLE[] AS b
            FROM embeddings JOIN heads USING (label)),
      s AS (SELECT vec_id, list_cosine_similarity(a, b) AS cosine, list_distance(a, b) AS l2 FROM p)
      SELECT vec_id, round(cosine, 6) + 0.0 AS cosine, round(1 - cosine, 6) + 0.0 AS cosine_distance,
             round(1 / (1 + (1 - cosine)), 6) AS reciprocal_cosine,
             round(1 / (1 + l2), 6) AS reciprocal_l2 FROM s""")
def score_transforms(t: Tables) -> DataFrame:
    heads = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    pairs = t.embeddings.join(heads, "label")
    scored = rt.dense_scores(pairs, "embedding", "head", "cosine").withColumnRenamed("score", "cosine")
    scored = rt.dense_scores(scored, "embedding", "head", "l2").withColumnRenamed("score", "reciprocal_l2")
    distance = vx.similarity_from_distance(F.col("cosine"))
    return scored.select(
        "vec_id", "cosine", distance.alias("cosine_distance"),
        vx.similarity_from_distance(distance, "reciprocal").alias("reciprocal_cosine"),
        "reciprocal_l2")


# --- ranking quality --------------------------------------------------------

_GRADED = f"""
      WITH {_knn_sql(_COS, 25)},
      g AS (SELECT query_id, rank, (collection = query_label)::INT AS grade FROM hits),
      rel AS (SELECT a.vec_id AS query_id, c.n AS n_relevant FROM embeddings a
              JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c USING (label))"""


def _graded(t: Tables) -> tuple[DataFrame, DataFrame]:
    hits = rt.dense_topk(t.vector_queries(), t.vector_index(), 25)
    labels = t.embeddings.select("vec_id", "label")
    graded = (
        hits.join(labels.toDF("query_id", "ql"), "query_id")
        .join(labels.toDF("chunk_id", "cl"), "chunk_id")
        .select("query_id", "rank", (F.col("ql") == F.col("cl")).cast("int").alias("grade"))
    )
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    relevant = labels.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return graded, relevant


def _at(k: int) -> str:
    return f"""
        coalesce(sum(grade) FILTER (rank <= {k}), 0) / any_value(n_relevant) AS recall_at_{k},
        coalesce(1.0 / min(rank) FILTER (rank <= {k} AND grade > 0), 0) AS mrr_at_{k},
        coalesce(sum(grade / log2(rank + 1)) FILTER (rank <= {k}), 0)
          / nullif(list_sum(list_transform(range(1, least(sum(grade), {k})::BIGINT + 1),
                   lambda i: 1 / log2(i + 1))), 0) AS ndcg_at_{k}"""


@BOOK.add("ranking_metrics", f"""{_GRADED},
      m AS (SELECT query_id, {_at(5)}, {_at(10)} FROM g JOIN rel USING (query_id) GROUP BY query_id)
      SELECT query_id, round(recall_at_5, 6) AS recall_at_5, round(mrr_at_5, 6) AS mrr_at_5,
             round(coalesce(ndcg_at_5, 0), 6) AS ndcg_at_5, round(recall_at_10, 6) AS recall_at_10,
             round(mrr_at_10, 6) AS mrr_at_10, round(coalesce(ndcg_at_10, 0), 6) AS ndcg_at_10
      FROM m""")
def ranking_metrics(t: Tables) -> DataFrame:
    return ev.ranking_metrics(*_graded(t), ks=(5, 10))


_BENCH = f"""{_GRADED},
      p AS (SELECT query_id, count(*) AS n, coalesce(sum(grade) FILTER (rank <= 10), 0) AS found,
                   min(rank) FILTER (rank <= 10 AND grade > 0) AS first,
                   coalesce(sum(grade / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg
            FROM g GROUP BY query_id),
      b AS (SELECT query_id, found / n AS recall, found / least(n, 10) AS precision,
                   (found > 0)::INT::DOUBLE AS hit_rate, coalesce(1.0 / first, 0) AS mrr,
                   coalesce(dcg / nullif(list_sum(list_transform(range(1, found::BIGINT + 1),
                            lambda i: 1 / log2(i + 1))), 0), 0) AS ndcg FROM p)"""


@BOOK.add("benchmark_metrics", f"""{_BENCH}
      SELECT query_id, round(recall, 6) AS recall, round(precision, 6) AS precision, hit_rate,
             round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM b""")
def benchmark_metrics(t: Tables) -> DataFrame:
    return ev.benchmark_metrics(_graded(t)[0], 10)


@BOOK.add("benchmark_means", f"""{_BENCH}
      SELECT count(*) AS num_queries, round(avg(recall), 6) AS recall,
             round(avg(precision), 6) AS precision, round(avg(hit_rate), 6) AS hit_rate,
             round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM b""")
def benchmark_means(t: Tables) -> DataFrame:
    names = ["recall", "precision", "hit_rate", "mrr", "ndcg"]
    return ev.mean_metrics(ev.benchmark_metrics(_graded(t)[0], 10), names)


@BOOK.add("graded_by_citations", f"""
      WITH {_knn_sql(_COS, 25)},
      cited AS (SELECT query_id, chunk_id FROM hits WHERE rank % 3 = 1),
      g AS (SELECT h.query_id, h.rank, (c.chunk_id IS NOT NULL)::INT AS grade
            FROM hits h LEFT JOIN cited c USING (query_id, chunk_id)),
      rel AS (SELECT query_id, count(*) AS n_relevant FROM cited GROUP BY query_id),
      m AS (SELECT query_id, {_at(5)} FROM g JOIN rel USING (query_id) GROUP BY query_id)
      SELECT query_id, round(recall_at_5, 6) AS recall_at_5, round(mrr_at_5, 6) AS mrr_at_5,
             round(coalesce(ndcg_at_5, 0), 6) AS ndcg_at_5 FROM m""")
def graded_by_citations(t: Tables) -> DataFrame:
    # Kept, for three readers: the search runs once.
    hits = kept_table(rt.dense_topk(t.vector_queries(), t.vector_index(), 25), "hits")
    cited = hits.filter(F.col("rank") % 3 == 1).select("query_id", "chunk_id")
    relevant = cited.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    return ev.ranking_metrics(ev.grade_hits(hits, cited), relevant, ks=(5,))


@BOOK.add("citation_precision", f"""
      WITH {_knn_sql(_COS, 10)}
      SELECT query_id, round(avg((score > 0.01)::INT), 6) AS citation_precision
      FROM hits GROUP BY query_id""")
def citation_precision(t: Tables) -> DataFrame:
    return ev.citation_precision(rt.dense_topk(t.vector_queries(), t.vector_index(), 10))


# --- vector checks ----------------------------------------------------------

@BOOK.add("l2_normalize", """
      WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS e
                 FROM embeddings),
      n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v)
      SELECT vec_id, round(norm, 4) AS norm_before,
             round(list_sum(list_transform(e, lambda x: (x / norm) * (x / norm))), 6) AS norm_after,
             round(list_sum(list_transform(e, lambda x: x / norm)), 6) + 0.0 AS total FROM n""")
def l2_normalize(t: Tables) -> DataFrame:
    scaled = t.embeddings.select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("e"))
    unit = scaled.select("vec_id", vx.norm(F.col("e")).alias("n"), vx.l2_normalize(F.col("e")).alias("u"))
    return unit.select(
        "vec_id", F.round("n", 4).alias("norm_before"), vx.dot(F.col("u"), F.col("u")).alias("norm_after"),
        F.aggregate("u", F.lit(0.0), lambda a, x: a + x).alias("total"))


# Writes to a stored table, read back: the table is written from one half of the vectors by label.
def _stored_table(t: Tables) -> tuple[StoredTable, DataFrame]:
    rows = t.vector_index().select(F.col("collection").cast("string"), "chunk_id", "embedding")
    store = StoredTable(t.spark, fresh_path(t.spark, "vectors"), rows.schema, parts=8, buckets=4)
    store.insert_ignore(rows.filter("collection < '5'"))
    return store, rows


def _read_back(store: StoredTable) -> DataFrame:
    return store.read().select("collection", "chunk_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@BOOK.add("stored_insert", """
      SELECT label::VARCHAR AS collection, vec_id AS chunk_id,
             round(embedding[1]::DOUBLE * CASE WHEN label < 5 THEN 1 ELSE 2 END, 6) + 0.0 AS first FROM embeddings""")
def stored_insert(t: Tables) -> DataFrame:
    """All vectors are offered again, doubled: those that are there stay as they are."""
    store, rows = _stored_table(t)
    store.insert_ignore(rows.withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float"))))
    return _read_back(store)


@BOOK.add("stored_update", """
      SELECT label::VARCHAR AS collection, vec_id AS chunk_id,
             round(embedding[1]::DOUBLE * CASE WHEN label > 2 THEN 2 ELSE 1 END, 6) + 0.0 AS first
      FROM embeddings WHERE label < 5""")
def stored_update(t: Tables) -> DataFrame:
    store, rows = _stored_table(t)
    store.update_by_id(rows.filter("collection > '2'").withColumn(
        "embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float"))))
    return _read_back(store)


@BOOK.add("stored_delete", """
      SELECT label::VARCHAR AS collection, vec_id AS chunk_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS first
      FROM embeddings WHERE label < 5 AND label <> 3""")
def stored_delete(t: Tables) -> DataFrame:
    store, rows = _stored_table(t)
    store.delete_by_id(rows.filter("collection = '3' OR collection > '6'"))
    return _read_back(store)


# Damaged copies of the vectors: by id, one in five each is emptied, cut short,
# given a NaN, given an infinity, or left alone.
_DAMAGED = """
      damaged AS (SELECT vec_id, CASE vec_id % 5
          WHEN 0 THEN []::DOUBLE[]
          WHEN 1 THEN list_slice(embedding, 1, 63)::DOUBLE[]
          WHEN 2 THEN list_append(list_slice(embedding, 1, 63)::DOUBLE[], 'nan'::DOUBLE)
          WHEN 3 THEN list_append(list_slice(embedding, 1, 63)::DOUBLE[], 'infinity'::DOUBLE)
          ELSE embedding::DOUBLE[] END AS embedding FROM embeddings)"""


def _damaged(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    cut = F.slice(e, 1, 63)
    kind = F.col("vec_id") % 5
    return t.embeddings.select(
        F.col("vec_id"),
        F.when(kind == 0, F.array().cast("array<double>"))
        .when(kind == 1, cut)
        .when(kind == 2, F.concat(cut, F.array(F.lit(float("nan")))))
        .when(kind == 3, F.concat(cut, F.array(F.lit(float("inf")))))
        .otherwise(e).alias("embedding"))


@BOOK.add("embedding_findings", f"""
      WITH {_DAMAGED}
      SELECT vec_id AS entity_id, 'empty' AS check_name, 'error' AS severity FROM damaged WHERE len(embedding) = 0
      UNION ALL SELECT vec_id, 'dimensions', 'error' FROM damaged WHERE len(embedding) <> 64
      UNION ALL SELECT vec_id, 'nan', 'error' FROM damaged
        WHERE len(list_filter(embedding, lambda x: isnan(x))) > 0
      UNION ALL SELECT vec_id, 'inf', 'error' FROM damaged
        WHERE len(list_filter(embedding, lambda x: isinf(x))) > 0""")
def embedding_findings(t: Tables) -> DataFrame:
    return ql.embedding_findings(_damaged(t), "vec_id", dims=64)


# Copies of every vector: one exact, one moved by less than the tolerance, one by more.
_COPIES = """
      copies AS (
        SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings
        UNION ALL SELECT vec_id + 1000000, embedding::DOUBLE[] FROM embeddings WHERE label < 3
        UNION ALL SELECT vec_id + 2000000, list_transform(embedding, lambda x: x::DOUBLE + 5e-7)
          FROM embeddings WHERE label < 5
        UNION ALL SELECT vec_id + 3000000, list_transform(embedding, lambda x: x::DOUBLE + 2e-6)
          FROM embeddings WHERE label < 7)"""


def _copies(t: Tables) -> DataFrame:
    base = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    moved = lambda by: F.transform("embedding", lambda x: x + F.lit(by))
    keep = ["vec_id", "embedding"]
    return (
        base.select(*keep)
        .unionByName(base.filter("label < 3").withColumn("vec_id", F.col("vec_id") + 1000000).select(*keep))
        .unionByName(base.filter("label < 5").withColumn("vec_id", F.col("vec_id") + 2000000)
                     .withColumn("embedding", moved(5e-7)).select(*keep))
        .unionByName(base.filter("label < 7").withColumn("vec_id", F.col("vec_id") + 3000000)
                     .withColumn("embedding", moved(2e-6)).select(*keep))
    )


@BOOK.add("embedding_duplicates", f"""
      WITH {_COPIES}
      SELECT a.vec_id AS entity_id, min(b.vec_id) AS duplicate_of
      FROM copies a JOIN copies b ON b.vec_id < a.vec_id
        AND abs(a.embedding[1] - b.embedding[1]) <= 1e-6
        AND list_max(list_transform(list_zip(a.embedding, b.embedding),
                     lambda p: abs(p[1] - p[2]))) <= 1e-6
      GROUP BY a.vec_id""")
def embedding_duplicates(t: Tables) -> DataFrame:
    return ql.embedding_duplicates(_copies(t), "vec_id", 1e-6)


@BOOK.add("index_findings", f"""
      WITH {_DAMAGED},
      idx AS (SELECT vec_id // 2 AS chunk_id, embedding,
                     CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'r' || (vec_id % 7) END AS report_id,
                     CASE WHEN vec_id % 11 = 0 THEN NULL ELSE 'v1' END AS version_id FROM damaged)
      SELECT chunk_id AS entity_id, 'dimensions' AS check_name, 'error' AS severity, count(*) AS n
        FROM idx WHERE len(embedding) <> 64 GROUP BY 1
      UNION ALL SELECT chunk_id, 'duplicate_id', 'error', count(*) - 1 FROM idx GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT chunk_id, 'empty', 'error', count(*) FROM idx WHERE len(embedding) = 0 GROUP BY 1
      UNION ALL SELECT chunk_id, 'nan', 'error', count(*) FROM idx
        WHERE len(list_filter(embedding, lambda x: isnan(x))) > 0 GROUP BY 1
      UNION ALL SELECT chunk_id, 'inf', 'error', count(*) FROM idx
        WHERE len(list_filter(embedding, lambda x: isinf(x))) > 0 GROUP BY 1
      UNION ALL SELECT chunk_id, 'missing_report', 'warning', count(*) FROM idx
        WHERE coalesce(report_id, '') = '' GROUP BY 1
      UNION ALL SELECT chunk_id, 'missing_version', 'warning', count(*) FROM idx
        WHERE coalesce(version_id, '') = '' GROUP BY 1""")
def index_findings(t: Tables) -> DataFrame:
    rows = _damaged(t).select(
        F.expr("vec_id div 2").alias("chunk_id"), "embedding",
        F.when(F.col("vec_id") % 7 == 0, "").otherwise(
            F.concat(F.lit("r"), F.col("vec_id") % 7)).alias("report_id"),
        F.when(F.col("vec_id") % 11 != 0, "v1").alias("version_id"))
    return ql.index_findings(rows, dims=64)


@BOOK.add("retrieval_findings", f"""
      WITH {_knn_sql(_COS, 10)},
      bad AS (SELECT query_id, CASE WHEN rank = 5 THEN chunk_id - 1 ELSE chunk_id END AS chunk_id,
                CASE WHEN rank % 4 = 0 THEN score * 2.5 ELSE score END AS score, rank FROM hits WHERE query_id % 50 <> 3)
      SELECT query_id, 'duplicate_id' AS check_name, count(*) AS n FROM (
          SELECT query_id, chunk_id FROM bad QUALIFY
            row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) > 1) GROUP BY 1
      UNION ALL SELECT query_id, 'score_range', count(*) FROM bad WHERE score < 0 OR score > 1 GROUP BY 1
      UNION ALL SELECT query_id, 'order', count(*) FROM (
          SELECT query_id, score, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS before FROM bad)
        WHERE score > before + 1e-9 GROUP BY 1
      UNION ALL SELECT vec_id, 'empty_result', 1 FROM embeddings WHERE vec_id % 50 = 3""")
def retrieval_findings(t: Tables) -> DataFrame:
    hits = rt.dense_topk(t.vector_queries(), t.vector_index(), 10)
    bad = hits.select(
        "query_id",
        F.when(F.col("rank") == 5, F.col("chunk_id") - 1).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("rank") % 4 == 0, F.col("score") * 2.5).otherwise(F.col("score")).alias("score"),
        "rank", F.lit("text").alias("content"))
    asked = t.vector_queries().select("query_id")
    bad = bad.filter(F.col("query_id") % 50 != 3)
    found = ql.retrieval_findings(bad, queries=asked)
    return found.groupBy("query_id", "check_name").agg(F.count(F.lit(1)).alias("n"))


# --- embedding stage --------------------------------------------------------

@BOOK.add("embedding_stats", """
      SELECT 'm' || (label % 3) AS embedding_model, 'given' AS embedding_provider,
             count(*) AS total, count(*) FILTER (len(embedding) > 0) AS embedded,
             count(*) FILTER (len(embedding) = 0) AS failed, max(len(embedding)) AS dimensions,
             ceil(count(*) / 32.0)::BIGINT AS batches
      FROM embeddings GROUP BY 1""")
def embedding_stats(t: Tables) -> DataFrame:
    rows = t.embeddings.select(
        "embedding", F.concat(F.lit("m"), F.col("label") % 3).alias("embedding_model"),
        F.lit("given").alias("embedding_provider"))
    return emb.embedding_stats(rows, batch_size=32)


@BOOK.add("embed_distinct", """
      WITH k AS (SELECT doc_id, sha256(text) AS text_key, text FROM documents)
      SELECT doc_id, text_key, 3::BIGINT AS dimensions,
             length(text)::DOUBLE AS size_feature FROM k""")
def embed_distinct(t: Tables) -> DataFrame:
    """Each distinct text encoded once; the encoder here measures the text."""
    docs = t.text("documents").select("doc_id", "text")
    out = emb.embed_distinct(docs, emb.measure_encoder)
    return out.select("doc_id", "text_key", "dimensions", F.col("embedding")[0].alias("size_feature"))


@BOOK.add("embed_batches")
def embed_batches(t: Tables) -> DataFrame:
    """Batched encoding with the hashing test encoder; failures become rows."""
    docs = t.text("documents").select(F.col("doc_id").alias("chunk_id"), "text")
    out = emb.embed(docs, emb.hashing_encoder(32), model="hashing-32", provider="local")
    return out.select("chunk_id", "dimensions", "embedding_model", "error",
                      F.round(vx.norm(F.col("embedding")), 4).alias("norm"))


# --- vector tables ----------------------------------------------------------

# Stored rows: two thirds of the vectors.  New rows: all of label 0-4, some known.
def _stored(t: Tables) -> DataFrame:
    return t.embeddings.filter(F.col("vec_id") % 3 != 0).select(
        F.concat(F.lit("report_"), "label").alias("collection"),
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("embedding"),
        F.lit("old").alias("text"))


def _incoming(t: Tables) -> DataFrame:
    return t.embeddings.filter("label < 5").select(
        F.concat(F.lit("report_"), "label").alias("collection"),
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("embedding"),
        F.lit("new").alias("text"))


_TABLES = """
      stored AS (SELECT 'report_' || label AS collection, vec_id AS chunk_id, 'old' AS text
                 FROM embeddings WHERE vec_id % 3 <> 0),
      incoming AS (SELECT 'report_' || label AS collection, vec_id AS chunk_id, 'new' AS text
                   FROM embeddings WHERE label < 5)"""


@BOOK.add("insert_ignore", f"""
      WITH {_TABLES}
      SELECT collection, chunk_id, text FROM stored
      UNION ALL SELECT collection, chunk_id, text FROM incoming i WHERE NOT EXISTS (
        SELECT 1 FROM stored s WHERE s.collection = i.collection AND s.chunk_id = i.chunk_id)""")
def insert_ignore(t: Tables) -> DataFrame:
    doubled = _incoming(t).unionByName(_incoming(t))
    return col.insert_ignore(_stored(t), doubled).select("collection", "chunk_id", "text")


@BOOK.add("insert_outcome", f"""
      WITH {_TABLES}
      SELECT i.collection, count(*) AS offered, count(*) FILTER (s.chunk_id IS NULL) AS inserted,
             count(*) FILTER (s.chunk_id IS NOT NULL) AS ignored
      FROM incoming i LEFT JOIN stored s USING (collection, chunk_id) GROUP BY 1""")
def insert_outcome(t: Tables) -> DataFrame:
    return col.insert_outcome(_stored(t), _incoming(t))


@BOOK.add("update_by_id", f"""
      WITH {_TABLES}
      SELECT s.collection, s.chunk_id, coalesce(i.text, s.text) AS text
      FROM stored s LEFT JOIN incoming i USING (collection, chunk_id)""")
def update_by_id(t: Tables) -> DataFrame:
    changes = _incoming(t).select("collection", "chunk_id", "text")
    return col.update_by_id(_stored(t), changes).select("collection", "chunk_id", "text")


@BOOK.add("delete_by_id", f"""
      WITH {_TABLES}
      SELECT collection, chunk_id, text FROM stored s WHERE NOT EXISTS (
        SELECT 1 FROM incoming i WHERE i.collection = s.collection AND i.chunk_id = s.chunk_id)""")
def delete_by_id(t: Tables) -> DataFrame:
    return col.delete_by_id(_stored(t), _incoming(t)).select("collection", "chunk_id", "text")


@BOOK.add("delete_by_filter", f"""
      WITH {_TABLES}
      SELECT collection, chunk_id, text FROM stored WHERE NOT (collection = 'report_4' AND text = 'old')""")
def delete_by_filter(t: Tables) -> DataFrame:
    kept = col.delete_by_filter(_stored(t), {"collection": "report_4", "text": "old"})
    kept = col.delete_by_filter(col.delete_by_filter(kept, {}), {"text": None})
    return kept.select("collection", "chunk_id", "text")


@BOOK.add("collection_counts", f"""
      WITH {_TABLES} SELECT collection, count(*) AS n FROM stored GROUP BY 1""")
def collection_counts(t: Tables) -> DataFrame:
    return col.collection_counts(_stored(t))


@BOOK.add("collection_exists", f"""
      WITH {_TABLES}, names AS (SELECT 'report_' || n_nationkey AS collection FROM nation)
      SELECT n.collection, EXISTS (SELECT 1 FROM stored s WHERE s.collection = n.collection) AS found
      FROM names n""")
def collection_exists(t: Tables) -> DataFrame:
    names = t.nation.select(F.concat(F.lit("report_"), "n_nationkey").alias("collection"))
    return col.collection_exists(_stored(t), names)


@BOOK.add("reindex", f"""
      WITH {_TABLES}
      SELECT collection, chunk_id, text FROM stored WHERE collection <> 'report_2'
      UNION ALL SELECT collection, chunk_id, text FROM incoming WHERE collection = 'report_2'""")
def reindex(t: Tables) -> DataFrame:
    """Written to disk: one partition replaced, the others untouched, then read back."""
    from corpuskit.session import fresh_path, kept_table
    from corpuskit.sources.index import read_index, write_index

    path = fresh_path(t.spark, "index")
    write_index(_stored(t), path)
    col.reindex(path, _incoming(t).filter("collection = 'report_2'"), "report_2")
    return read_index(t.spark, path).select("collection", "chunk_id", "text")


@BOOK.add("read_one_collection", f"""
      WITH {_TABLES} SELECT chunk_id, text FROM stored WHERE collection = 'report_7'""")
def read_one_collection(t: Tables) -> DataFrame:
    from corpuskit.session import fresh_path, kept_table
    from corpuskit.sources.index import read_index, write_index

    path = fresh_path(t.spark, "index")
    write_index(_stored(t), path)
    return read_index(t.spark, path, "report_7").select("chunk_id", "text")


@BOOK.add("to_index_rows", """
      SELECT 'c' || vec_id AS chunk_id, 'r' || label AS report_id, '' AS version_id,
             64::BIGINT AS dimensions, 'page' AS extra_key, (vec_id % 9)::VARCHAR AS extra_value
      FROM embeddings""")
def to_index_rows(t: Tables) -> DataFrame:
    embedded = t.embeddings.select(
        F.concat(F.lit("c"), "vec_id").alias("chunk_id"), "embedding", F.lit("body").alias("text"),
        F.create_map(
            F.lit("report_id"), F.concat(F.lit("r"), "label"),
            F.lit("page"), (F.col("vec_id") % 9).cast("string")).alias("metadata"),
        F.lit("m").alias("embedding_model"), F.lit("p").alias("embedding_provider"))
    rows = col.to_index_rows(embedded)
    return rows.select("chunk_id", "report_id", "version_id", "dimensions",
                       F.explode("extra").alias("extra_key", "extra_value"))


@BOOK.add("indexing_stats", f"""
      WITH {_DAMAGED}
      SELECT 'report_' || (vec_id % 10) AS collection, count(*) AS total,
             count(*) FILTER (len(embedding) = 64) AS succeeded,
             count(*) FILTER (len(embedding) <> 64) AS failed
      FROM damaged GROUP BY 1""")
def indexing_stats(t: Tables) -> DataFrame:
    rows = _damaged(t).withColumn("collection", F.concat(F.lit("report_"), F.col("vec_id") % 10))
    return col.indexing_stats(rows, F.size("embedding") == 64)
