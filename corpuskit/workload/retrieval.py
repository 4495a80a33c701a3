"""BM25, fusion, query expansion and reranking over documents and benchmark texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.functions import vectors as vx
from corpuskit.operators import evaluation as ev
from corpuskit.operators import reranking as rr
from corpuskit.operators import retrieval as rt
from corpuskit.operators.postings import Postings
from corpuskit.session import fresh_path
from corpuskit.workload.common import Book, Tables

BOOK = Book()


def words_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda w: w <> '')"


def bm25_sql(queries: str = "SELECT item_id AS query_id, text FROM benchmark",
             k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs ending in bm(query_id, chunk_id, score)."""
    return f"""
      queries AS ({queries}),
      bag AS (SELECT doc_id AS chunk_id, {words_sql('text')} AS words FROM documents),
      dl AS (SELECT chunk_id, len(words) AS n FROM bag),
      st AS (SELECT count(*) AS nd, avg(n) AS al FROM dl),
      tf AS (SELECT chunk_id, term, count(*) AS tf
             FROM (SELECT chunk_id, unnest(words) AS term FROM bag) GROUP BY ALL),
      dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      qt AS (SELECT DISTINCT query_id, unnest({words_sql('text')}) AS term FROM queries),
      bm AS (SELECT query_id, chunk_id,
               sum(ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * {k1 + 1}
                   / (tf + {k1} * (1 - {b} + {b} * n / al))) AS score
             FROM qt JOIN tf USING (term) JOIN dfq USING (term) JOIN dl USING (chunk_id), st
             GROUP BY ALL)"""


def top_sql(source: str, k: int, by: str = "query_id") -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY {by}
               ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source} QUALIFY rank <= {k}"""


@BOOK.add("bm25_stats", f"""
      WITH {bm25_sql()} SELECT nd AS n_docs, round(al, 6) AS avg_len FROM st""")
def bm25_stats(t: Tables) -> DataFrame:
    return rt.bm25_stats(rt.bm25_index(t.corpus())).drop("collection")


@BOOK.add("bm25_index", f"""
      WITH {bm25_sql()}
      SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences, max(tf) AS most FROM tf GROUP BY term""")
def bm25_index(t: Tables) -> DataFrame:
    postings = rt.bm25_index(t.corpus())
    return postings.filter(F.col("term") != rt.MARK).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


for _name, _k1, _b in (("bm25_topk", 1.2, 0.75), ("bm25_topk_other_weights", 2.0, 0.4)):

    @BOOK.add(_name, f"""
      WITH {bm25_sql(k1=_k1, b=_b)}, hits AS ({top_sql('bm', 10)})
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
    def _bm25(t: Tables, k1: float = _k1, b: float = _b) -> DataFrame:
        return rt.bm25_topk(t.text_queries(), t.corpus(), 10, k1, b)


_NORM = """
      bounds AS (SELECT query_id, max(score) AS hi,
                   CASE WHEN count(*) < (SELECT nd FROM st) THEN least(min(score), 0) ELSE min(score) END AS lo
                 FROM bm GROUP BY query_id),
      sparse AS (SELECT query_id, chunk_id,
                   CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score
                 FROM bm JOIN bounds USING (query_id))"""


@BOOK.add("minmax_scores", f"""
      WITH {bm25_sql()}, {_NORM}
      SELECT query_id, chunk_id, round(score, 6) AS score FROM sparse""")
def minmax_scores(t: Tables) -> DataFrame:
    """All matching rows, scaled by the range of all scores of their query."""
    return rt.bm25_normalised(t.text_queries(), t.corpus(), None)


# The dense leg: a query's vector is the one with its id, a document's likewise.
def _dense_sql(k: int) -> str:
    return f"""
      dn AS (SELECT item_id AS query_id, b.vec_id AS chunk_id,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
             FROM benchmark JOIN embeddings a ON a.vec_id = item_id CROSS JOIN embeddings b
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k}),
      db AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM dn GROUP BY query_id),
      dense AS (SELECT query_id, chunk_id,
                  CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score
                FROM dn JOIN db USING (query_id))"""


_FUSED = """
      fused AS (SELECT query_id, chunk_id,
                  coalesce(d.score, 0) * {d} + coalesce(s.score, 0) * {s} AS score
                FROM dense d FULL JOIN sparse s USING (query_id, chunk_id))"""


def _query_vectors(t: Tables) -> DataFrame:
    return t.text_queries().join(
        t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


def _index(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")


@BOOK.add("hybrid_topk", f"""
      WITH {bm25_sql()}, {_NORM}, {_dense_sql(20)}, {_FUSED.format(d=0.5, s=0.5)},
      hits AS ({top_sql('fused', 10)})
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
def hybrid_topk(t: Tables) -> DataFrame:
    return rt.hybrid_topk(_query_vectors(t), _index(t), t.corpus(), 10)


@BOOK.add("hybrid_weighted_threshold", f"""
      WITH {bm25_sql()}, {_NORM}, {_dense_sql(20)}, {_FUSED.format(d='(3.0/4.0)', s='(1.0/4.0)')},
      hits AS ({top_sql('fused', 10)})
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits WHERE score >= 0.35""")
def hybrid_weighted_threshold(t: Tables) -> DataFrame:
    """Weights that do not sum to one are scaled first."""
    return rt.hybrid_topk(
        _query_vectors(t), _index(t), t.corpus(), 10, {"dense": 3.0, "sparse": 1.0}, threshold=0.35)


_SYN = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in rt.SYNONYMS.items()) + "}"
_EXPAND = rf"""
      base AS (SELECT item_id AS query_id, text, trim(text) AS q,
                 list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM benchmark),
      opts AS (SELECT query_id, [
          text,
          CASE WHEN len(w) > 3 THEN array_to_string(list_filter(w, lambda x, i: i % 2 = 1), ' ') END,
          CASE WHEN len(w) > 2 THEN nullif(w[1] || ' ' || w[len(w)], q) END,
          nullif(array_to_string(list_transform(w, lambda x: coalesce({_SYN}[x], x)), ' '), q)] AS o
        FROM base),
      variants AS (SELECT query_id, unnest(v) AS text, generate_subscripts(v, 1) - 1 AS variant
        FROM (SELECT query_id, list_slice(list_filter(o, lambda x: x IS NOT NULL), 1, 3) AS v FROM opts))"""


@BOOK.add("expand_queries", f"WITH {_EXPAND} SELECT query_id, variant, text FROM variants")
def expand_queries(t: Tables) -> DataFrame:
    return rt.expand_queries(t.text_queries(), 3)


@BOOK.add("multi_query_topk", f"""
      WITH {_EXPAND}, {bm25_sql("SELECT query_id * 10 + variant AS query_id, text FROM variants")},
      per_variant AS ({top_sql('bm', 10)}),
      best AS (SELECT query_id // 10 AS query_id, chunk_id, max(score) AS score
               FROM per_variant GROUP BY ALL),
      hits AS ({top_sql('best', 10)})
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
def multi_query_topk(t: Tables) -> DataFrame:
    return rt.multi_query_topk(t.text_queries(), t.corpus(), 10)


@BOOK.add("bm25_fill", f"""
      WITH {bm25_sql()}, {_dense_sql(10)},
      rest AS (SELECT * FROM bm WHERE query_id IN (SELECT query_id FROM dn)
                 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM dn)),
      added AS ({top_sql('rest', 5)})
      SELECT query_id, chunk_id, round(score, 6) + 0.0 AS score, 'dense' AS origin FROM dn
      UNION ALL SELECT query_id, chunk_id, 0.0, 'bm25' FROM added""")
def bm25_fill(t: Tables) -> DataFrame:
    queries = _query_vectors(t)
    dense = rt.dense_topk(queries, _index(t), 10)
    return rt.bm25_fill(dense, rt.bm25_topk(queries.select("query_id", "text"), t.corpus(), 15), 5, most_dense=10)


# --- by collection ----------------------------------------------------------

# A document's source is its collection; every query asks two of them.
_ASKED = "['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)]"


def collection_sql(k1: float = 1.2, b: float = 0.75, queries: str = "benchmark") -> str:
    """CTEs ending in bm(query_id, collection, chunk_id, score), a corpus for each source."""
    return f"""
      queries AS (SELECT item_id AS query_id, text, unnest({_ASKED}) AS collection FROM {queries}),
      bag AS (SELECT doc_id AS chunk_id, source AS collection, {words_sql('text')} AS words FROM documents),
      dl AS (SELECT collection, chunk_id, len(words) AS n FROM bag),
      st AS (SELECT collection, count(*) AS nd, avg(n) AS al FROM dl GROUP BY collection),
      tf AS (SELECT collection, chunk_id, term, count(*) AS tf
             FROM (SELECT collection, chunk_id, unnest(words) AS term FROM bag) GROUP BY ALL),
      dfq AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL),
      qt AS (SELECT DISTINCT query_id, collection, unnest({words_sql('text')}) AS term FROM queries),
      bm AS (SELECT query_id, collection, chunk_id,
               sum(ln((nd - df + 0.5) / (df + 0.5) + 1) * tf * {k1 + 1}
                   / (tf + {k1} * (1 - {b} + {b} * n / al))) AS score
             FROM qt JOIN tf USING (collection, term) JOIN dfq USING (collection, term)
               JOIN dl USING (collection, chunk_id) JOIN st USING (collection) GROUP BY ALL)"""


def collection_queries(t: Tables) -> DataFrame:
    names = [F.concat(F.lit("src"), ((F.col("item_id") + n) % 20).cast("string")) for n in (0, 7)]
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text", F.array(*names).alias("collections"))


def collection_corpus(t: Tables) -> DataFrame:
    return t.text("documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("collection"))


_BY = "query_id, collection"


@BOOK.add("bm25_per_collection", f"""
      WITH {collection_sql()}, hits AS ({top_sql('bm', 5, _BY)})
      SELECT query_id, collection, chunk_id, round(score, 6) AS score, rank FROM hits""")
def bm25_per_collection(t: Tables) -> DataFrame:
    return rt.bm25_topk(collection_queries(t), collection_corpus(t), 5)


@BOOK.add("bm25_stored_postings", f"""
      WITH {collection_sql(1.5, 0.6)}, hits AS ({top_sql('bm', 5, _BY)})
      SELECT query_id, collection, chunk_id, round(score, 6) AS score, rank FROM hits""")
def bm25_stored_postings(t: Tables) -> DataFrame:
    """Written as two batches, then read block by block as far as bounds allow."""
    store = Postings(t.spark, fresh_path(t.spark, "postings"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for batch in (t.documents.filter(english), t.documents.filter(~english)):
        store.append(batch.select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("collection")))
    return store.topk(collection_queries(t), 5, 1.5, 0.6)


# The dense leg by collection: the vector of a document has its id.
def _collection_dense_sql(k: int) -> str:
    return f"""
      dn AS (SELECT q.query_id, q.collection, b.vec_id AS chunk_id,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
             FROM (SELECT DISTINCT query_id, collection FROM queries) q JOIN embeddings a ON a.vec_id = q.query_id
               JOIN documents d ON d.source = q.collection JOIN embeddings b ON b.vec_id = d.doc_id
             QUALIFY row_number() OVER (PARTITION BY q.query_id, q.collection ORDER BY score DESC, chunk_id) <= {k})"""


def _collection_vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    index = t.documents.select(F.col("doc_id").alias("vec_id"), F.col("source").alias("collection")).join(
        t.embeddings.select("vec_id", "embedding"), "vec_id")
    return collection_queries(t).join(vectors, "query_id"), index.withColumnRenamed("vec_id", "chunk_id")


@BOOK.add("hybrid_per_collection", f"""
      WITH {collection_sql()}, {_collection_dense_sql(10)},
      bounds AS (SELECT query_id, bm.collection, max(score) AS hi,
                   CASE WHEN count(*) < any_value(nd) THEN least(min(score), 0) ELSE min(score) END AS lo
                 FROM bm JOIN st USING (collection) GROUP BY ALL),
      sparse AS (SELECT query_id, collection, chunk_id,
                   CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score
                 FROM bm JOIN bounds USING (query_id, collection)
                 UNION ALL SELECT query_id, collection, chunk_id, 1.0 FROM dn
                 WHERE (query_id, collection) NOT IN (SELECT (query_id, collection) FROM bounds)),
      db AS (SELECT query_id, collection, min(score) AS lo, max(score) AS hi FROM dn GROUP BY ALL),
      dense AS (SELECT query_id, collection, chunk_id,
                  CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score
                FROM dn JOIN db USING (query_id, collection)),
      fused AS (SELECT query_id, collection, chunk_id, coalesce(d.score, 0) * 0.5 + coalesce(s.score, 0) * 0.5 AS score
                FROM dense d FULL JOIN sparse s USING (query_id, collection, chunk_id)
                WHERE query_id IN (SELECT vec_id FROM embeddings)),
      hits AS ({top_sql('fused', 5, _BY)})
      SELECT query_id, collection, chunk_id, round(score, 6) AS score, rank FROM hits""")
def hybrid_per_collection(t: Tables) -> DataFrame:
    queries, index = _collection_vectors(t)
    return rt.hybrid_topk(queries, index, collection_corpus(t), 5)


@BOOK.add("bm25_fill_per_collection", f"""
      WITH {collection_sql()}, {_collection_dense_sql(4)},
      rest AS (SELECT bm.* FROM bm ANTI JOIN dn USING (query_id, collection, chunk_id)
               WHERE query_id IN (SELECT vec_id FROM embeddings)),
      added AS ({top_sql('rest', 3, _BY)})
      SELECT query_id, collection, chunk_id, round(score, 6) + 0.0 AS score, 'dense' AS origin FROM dn
      UNION ALL SELECT query_id, collection, chunk_id, 0.0, 'bm25' FROM added""")
def bm25_fill_per_collection(t: Tables) -> DataFrame:
    queries, index = _collection_vectors(t)
    dense = rt.dense_topk(queries, index, 4, per_collection=True)
    sparse = rt.bm25_topk(queries.drop("embedding"), collection_corpus(t), 7)
    return rt.bm25_fill(dense, sparse, 3, ("query_id", "collection"), most_dense=4)


# A variant's vector: the one numbered from its query and place.
@BOOK.add("multi_query_dense", f"""
      WITH {_EXPAND},
      scored AS (SELECT v.query_id, v.variant, b.vec_id AS chunk_id,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score
             FROM variants v JOIN embeddings a ON a.vec_id = v.query_id * 3 + v.variant CROSS JOIN embeddings b
             QUALIFY row_number() OVER (PARTITION BY v.query_id, v.variant ORDER BY score DESC, chunk_id) <= 8),
      best AS (SELECT query_id, chunk_id, max(score) AS score FROM scored GROUP BY ALL),
      hits AS ({top_sql('best', 8)})
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
def multi_query_dense(t: Tables) -> DataFrame:
    def retrieve(variants: DataFrame, k: int) -> DataFrame:
        number = F.col("query_id.query_id") * 3 + F.col("query_id.variant")
        vectors = t.embeddings.select(F.col("vec_id").alias("_n"), "embedding")
        return rt.dense_topk(variants.withColumn("_n", number).join(vectors, "_n").drop("_n"), _index(t), k)

    return rt.multi_query_topk(t.text_queries(), None, 8, retrieve=retrieve)


# --- reranking --------------------------------------------------------------


def hits_with_text(t: Tables, k: int) -> DataFrame:
    """BM25 hits with the document's text: query_id, chunk_id, score, rank, content, source."""
    hits = rt.bm25_topk(t.text_queries(), t.corpus(), k)
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    return rt.attach_content(hits, docs, k * t.benchmark.count())


_BAG = rf"list_distinct({words_sql('text')})"


@BOOK.add("word_jaccard", f"""
      WITH {bm25_sql()}, hits AS ({top_sql('bm', 10)}),
      q AS (SELECT item_id AS query_id, {_BAG} AS qw FROM benchmark),
      d AS (SELECT doc_id AS chunk_id, {_BAG} AS dw FROM documents)
      SELECT query_id, chunk_id, round(CASE WHEN len(qw) = 0 OR len(dw) = 0 THEN 0.0 ELSE
        len(list_intersect(qw, dw)) / len(list_distinct(list_concat(qw, dw))) END, 6) AS overlap
      FROM hits JOIN q USING (query_id) JOIN d USING (chunk_id)""")
def word_jaccard(t: Tables) -> DataFrame:
    pairs = hits_with_text(t, 10).join(t.text_queries(), "query_id")
    return pairs.select(
        "query_id", "chunk_id",
        vx.jaccard(F.array_distinct(tx.terms(F.col("text"))), F.array_distinct(tx.terms(F.col("content"))))
        .alias("overlap"))


@BOOK.add("mmr_topk", f"""
      WITH RECURSIVE {bm25_sql()}, hits AS ({top_sql('bm', 12)}),
      c AS (SELECT query_id, chunk_id, score, rank, {_BAG} AS w
            FROM hits JOIN documents ON doc_id = chunk_id),
      sim AS (SELECT a.query_id, a.chunk_id AS x, b.chunk_id AS y,
                CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE
                  len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS s
              FROM c a JOIN c b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id),
      step AS (
        SELECT query_id, 1 AS n, [chunk_id] AS chosen FROM c WHERE rank = 1
        UNION ALL
        SELECT query_id, n + 1, list_append(chosen, pick) FROM (
          SELECT p.query_id, p.n, p.chosen,
            (SELECT arg_min(c.chunk_id, (-round(0.7 * c.score - 0.3 * (
                 SELECT max(s) FROM sim WHERE sim.query_id = p.query_id AND sim.x = c.chunk_id
                   AND list_contains(p.chosen, sim.y)), 9), c.rank))
             FROM c WHERE c.query_id = p.query_id AND NOT list_contains(p.chosen, c.chunk_id)) AS pick
          FROM step p WHERE p.n < 4) WHERE pick IS NOT NULL),
      last AS (SELECT query_id, arg_max(chosen, n) AS chosen FROM step GROUP BY query_id),
      flat AS (SELECT query_id, unnest(chosen) AS chunk_id, generate_subscripts(chosen, 1) AS rank,
                 len(chosen) AS n FROM last)
      SELECT f.query_id, f.chunk_id, f.rank, round(1 - (f.rank - 1) / f.n, 6) AS score,
             round(c.score, 6) AS original_score
      FROM flat f JOIN c USING (query_id, chunk_id)""")
def mmr_topk(t: Tables) -> DataFrame:
    return rr.mmr(hits_with_text(t, 12), lambda_=0.7, k=4)


@BOOK.add("rank_scores", f"""
      WITH {bm25_sql()}, hits AS ({top_sql('bm', 10)})
      SELECT query_id, chunk_id, rank, round(score, 6) AS original_score,
             round(1 - (rank - 1) / count(*) OVER (PARTITION BY query_id), 6) AS score FROM hits""")
def rank_scores(t: Tables) -> DataFrame:
    return rr.rank_scores(rt.bm25_topk(t.text_queries(), t.corpus(), 10))


@BOOK.add("rerank_identity", f"""
      WITH {bm25_sql()}, hits AS ({top_sql('bm', 10)})
      SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits""")
def rerank_identity(t: Tables) -> DataFrame:
    return rr.identity(rt.bm25_topk(t.text_queries(), t.corpus(), 10))


@BOOK.add("rerank_pairwise", f"""
      WITH {bm25_sql()}, hits AS ({top_sql('bm', 10)}),
      q AS (SELECT item_id AS query_id, {_BAG} AS qw FROM benchmark),
      d AS (SELECT doc_id AS chunk_id, {_BAG} AS dw FROM documents),
      s AS (SELECT query_id, chunk_id, rank AS old,
              round(len(list_intersect(qw, dw)) / len(qw), 9) AS score
            FROM hits JOIN q USING (query_id) JOIN d USING (chunk_id))
      SELECT query_id, chunk_id, round(score, 6) AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM s""")
def rerank_pairwise(t: Tables) -> DataFrame:
    """Scored by the share of query words present: a stand-in for a cross-encoder."""
    out = rr.rerank_pairwise(hits_with_text(t, 10), t.text_queries(), rr.overlap_scorer)
    return out.select("query_id", "chunk_id", "score", "rank")


# --- quality of BM25 hits against the labels --------------------------------


@BOOK.add("labelled_quality", f"""
      WITH {bm25_sql()}, hits AS ({top_sql('bm', 10)}),
      g AS (SELECT query_id, rank, coalesce(quality, 0) AS grade
            FROM hits LEFT JOIN labels ON doc_id = chunk_id)
      SELECT query_id, round(sum((grade > 0)::INT) / count(*), 6) AS recall,
             coalesce(round(1.0 / min(rank) FILTER (grade > 0), 6), 0) AS mrr FROM g GROUP BY query_id""")
def labelled_quality(t: Tables) -> DataFrame:
    hits = rt.bm25_topk(t.text_queries(), t.corpus(), 10)
    graded = hits.join(
        t.labels.select(F.col("doc_id").alias("chunk_id"), F.col("quality").alias("grade")),
        "chunk_id", "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    return ev.benchmark_metrics(graded, 10).select("query_id", "recall", "mrr")


@BOOK.add("topic_coverage", f"""
      WITH {bm25_sql()}, hits AS ({top_sql('bm', 5)}),
      topics AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'),
                   lambda w: length(w) > 7)) AS topic FROM queries),
      seen AS (SELECT DISTINCT query_id, topic FROM topics JOIN hits USING (query_id)
               JOIN documents ON doc_id = chunk_id WHERE contains(lower(text), lower(topic)))
      SELECT query_id, round(avg((s.topic IS NOT NULL)::INT), 6) AS topic_coverage
      FROM topics LEFT JOIN seen s USING (query_id, topic) GROUP BY query_id""")
def topic_coverage(t: Tables) -> DataFrame:
    """The long words of a query stand for its expected topics."""
    topics = t.text_queries().select(
        "query_id", F.filter(tx.words(F.col("text")), lambda w: F.length(w) > 7).alias("topics"))
    return ev.topic_coverage(hits_with_text(t, 5), topics)
