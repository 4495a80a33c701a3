import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import embedding as emb
from corpuskit.operators import reranking as rr
from corpuskit.operators import retrieval as rt


def vectors(spark, n, name, seed, dims=8):
    rng = random.Random(seed)
    data = [(i, [rng.gauss(0, 1) for _ in range(dims)], i % 3) for i in range(n)]
    data.append((n, [1.0], 0))  # wrong length: never a neighbour
    return spark.createDataFrame(data, f"{name} long, embedding array<double>, collection int")


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_small_blocks_equal_one_block(spark, metric):
    q, x = vectors(spark, 30, "query_id", 1), vectors(spark, 60, "chunk_id", 2)
    a = rt.dense_topk(q, x, 5, metric)
    b = rt.dense_topk(q, x.repartition(5), 5, metric, block_rows=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    # The odd query has the odd row as its only neighbour.
    assert a.count() == 30 * 5 + 1


def test_per_collection_paths_agree(spark):
    q = vectors(spark, 20, "query_id", 1).withColumn("collections", F.array("collection", F.lit(1)))
    x = vectors(spark, 40, "chunk_id", 2)
    a = rt.dense_topk(q, x, 3, per_collection=True)
    b = rt.dense_topk(q, x, 3, per_collection=True, block_rows=6)
    key = lambda r: (r.query_id, r.chunk_id, r.collection, r.score, r["rank"])
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def test_the_driver_sees_no_query_vector(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def guarded(name, old=None):
        def run(self, *args, **kwargs):
            assert "embedding" not in self.columns and self.isEmpty()
            return old(self, *args, **kwargs)

        monkeypatch.setattr(DataFrame, name, run)

    for name in ("collect", "toPandas", "toLocalIterator"):
        guarded(name)
    guarded("toArrow", DataFrame.toArrow)
    hits = rt.dense_topk(vectors(spark, 30, "query_id", 1), vectors(spark, 60, "chunk_id", 2), 5, block_rows=9)
    plan = hits._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    hits.write.format("noop").mode("overwrite").save()


def test_no_queries(spark):
    q = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert rt.dense_topk(q, vectors(spark, 5, "chunk_id", 2), 3).count() == 0


def corpus(spark):
    return spark.createDataFrame(
        [(1, "The cat sat on the mat"), (2, "Dogs chase a cat"), (3, "nothing here")], "chunk_id long, text string")


def test_bm25_order_and_large_vocabulary_path(spark, monkeypatch):
    q = spark.createDataFrame([(1, "cat mat"), (2, "zebra")], "query_id long, text string")
    hits = rt.bm25_topk(q, corpus(spark), 5).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.chunk_id) for h in hits] == [(1, 1), (1, 2)]
    monkeypatch.setattr(rt, "few_terms", lambda *a, **k: False)
    monkeypatch.setattr(rt.sp, "weights", lambda *a, **k: None)
    again = rt.bm25_topk(q, corpus(spark), 5).orderBy("query_id", "rank").collect()
    assert [(round(h.score, 9), h.chunk_id) for h in again] == [(round(h.score, 9), h.chunk_id) for h in hits]


def test_minmax_and_weights(spark):
    hits = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, 3.0)], "query_id int, chunk_id int, score double")
    got = {(r.query_id, r.chunk_id): r.score for r in rt.minmax_normalise(hits).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (2, 1): 0.0, (2, 2): 1.0}
    assert {r.score for r in rt.minmax_normalise(hits, constant_value=0.0).filter("query_id=1").collect()} == {0.0}
    assert sum(rt.normalised_weights({"dense": 2, "sparse": 6}).values()) == 1.0


def test_expand(spark):
    q = spark.createDataFrame([(1, "how to find the report"), (2, "one"), (3, "  ")], "query_id int, text string")
    got = [(r.query_id, r.text) for r in rt.expand_queries(q, 4).orderBy("query_id", "variant").collect()]
    assert got == [(1, "how to find the report"), (1, "how find report"), (1, "how report"),
                   (1, "what to search the analysis"), (2, "one")]


def hits(spark):
    return spark.createDataFrame(
        [(1, 10, 0.9, 1, "red green blue"), (1, 11, 0.8, 2, "red green blue"), (1, 12, 0.5, 3, "other words")],
        "query_id int, chunk_id int, score double, rank int, content string")


def test_mmr(spark):
    got = rr.mmr(hits(spark), 0.4, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score, r.original_score) for r in got] == [(10, 1.0, 0.9), (12, 0.5, 0.5)]
    top = rr.mmr(hits(spark), 1.0, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == [10, 11, 12]


def broken_scorer():
    def score(asked, content):
        raise RuntimeError("model down")

    return score


def test_failed_reranker_keeps_order(spark):
    q = spark.createDataFrame([(1, "other words")], "query_id int, text string")
    kept = rr.rerank_pairwise(hits(spark), q, broken_scorer).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in kept] == [(10, 0.9), (11, 0.8), (12, 0.5)]
    moved = rr.rerank_pairwise(hits(spark), q, rr.overlap_scorer).orderBy("rank").collect()
    assert [r.chunk_id for r in moved] == [12, 10, 11]


def failing_encoder():
    def encode(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    return encode


def test_failed_batch_becomes_rows(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string").coalesce(1)
    got = {r.id: r for r in emb.embed(df, failing_encoder, batch_size=1).collect()}
    assert got[1].embedding == [4.0] and got[1].error is None
    assert got[2].embedding == [] and "bad text" in got[2].error


def test_embed_distinct_with_known_vectors(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb")], "id int, text string")
    known = spark.createDataFrame([("aa", [7.0])], "text string, embedding array<double>").select(
        F.sha2("text", 256).alias("text_key"), "embedding", F.lit(1).alias("dimensions"))
    got = {r.id: r.embedding[0] for r in emb.embed_distinct(df, emb.measure_encoder, known=known).collect()}
    assert got == {1: 7.0, 2: 7.0, 3: 3.0}


def test_mmr_takes_any_number_of_candidates(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(1, i, 1.0 - i / 5000, i + 1, " ".join(rng.sample(words, 6))) for i in range(5000)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int, content string")
    got = [r.chunk_id for r in rr.mmr(hits, 0.5, 4).orderBy("rank").collect()]
    sets = [set(r[4].split()) for r in rows]
    picks = [0]
    while len(picks) < 4:
        def gain(i):
            near = max(len(sets[i] & sets[p]) / len(sets[i] | sets[p]) for p in picks)
            return round(0.5 * rows[i][2] - 0.5 * near, 9)

        picks.append(max((i for i in range(5000) if i not in picks), key=lambda i: (gain(i), -i)))
    assert got == picks


def test_empty_filter_deletes_nothing_and_conflicts_are_ordered(spark):
    from corpuskit.operators import collections as col

    index = spark.createDataFrame([("a", 1, "x"), ("a", 2, None)], "collection string, chunk_id int, text string")
    assert col.delete_by_filter(index, {}).count() == 2
    assert col.delete_by_filter(index, {"text": None}).count() == 2
    assert col.delete_by_filter(index, {"text": "x"}).count() == 1
    new = spark.createDataFrame([("b", 1, "late"), ("b", 1, "early")], "collection string, chunk_id int, text string")
    assert col.insert_ignore(index, new).filter("collection = 'b'").first().text == "early"


def collections(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, range(40, 0, -1), k=rng.randint(0, 60))), f"c{i % 3}") for i in range(300)]
    rows += [(300, None, "c0"), (301, "", "c1"), (302, "W1 W1 \u00c9 \u00e9", "c2")]
    asked = [(i, " ".join(rng.choices(words + ["unseen"], k=rng.randint(1, 5))), ["c0", f"c{i % 3}", "nowhere"])
             for i in range(12)] + [(12, "", ["c1"]), (13, "w1", []), (14, "w1", None), (15, "unseen", ["c2"])]
    return (spark.createDataFrame(rows, "chunk_id long, text string, collection string"),
            spark.createDataFrame(asked, "query_id long, text string, collections array<string>"))


def rounded(hits):
    return sorted((r.query_id, r.collection, r.chunk_id, round(r.score, 6), r["rank"]) for r in hits.collect())


def test_counted_terms(spark):
    docs, _ = collections(spark)
    from collections import Counter

    from corpuskit.operators.sparse import counted

    texts = {r.chunk_id: (r.text or "").lower().split() for r in docs.collect()}
    for r in counted(docs).collect():
        assert dict(zip(r.terms, r.tfs)) == Counter(texts[r.chunk_id]) and r.doc_len == len(texts[r.chunk_id])


def test_counts_of_some_terms(spark):
    from corpuskit.operators import sparse as sp

    docs, _ = collections(spark)
    some = sorted({t for r in sp.counted(docs).collect() for t in r.terms})[::3]
    whole = {r.chunk_id: (r.doc_len, {t: n for t, n in zip(r.terms, r.tfs) if t in some}) for r in sp.counted(docs).collect()}
    found = {r.chunk_id: (r.doc_len, dict(zip(r.terms, r.tfs))) for r in sp.counted_among(docs, [*some, "unheard-of"]).collect()}
    assert found == whole


def test_all_scaled_scores_are_listed(spark, monkeypatch):
    docs, asked = collections(spark)

    def listed():
        return {(r.query_id, r.collection, r.chunk_id): round(r.score, 6) for r in rt.bm25_normalised(asked, docs, None).collect()}

    found = listed()
    assert set(found) == {(r.query_id, r.collection, r.chunk_id) for r in rt.bm25_scores(asked, docs).collect()}
    best = {(r.query_id, r.collection, r.chunk_id): round(r.score, 6) for r in rt.bm25_normalised(asked, docs, 2).collect()}
    assert len(best) < len(found) and best.items() <= found.items()
    monkeypatch.setattr(rt.sp, "CELLS", 50)
    assert listed() == found
    monkeypatch.setattr(rt.sp, "weights", lambda *a, **k: None)
    assert listed() == found


def test_texts_are_read_once(spark, tmp_path):
    docs, asked = collections(spark)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rt.bm25_topk(asked, docs.mapInArrow(seen, docs.schema), 6).collect()
    assert read.value == docs.count()


def test_bm25_scan_equals_joins_by_collection(spark, monkeypatch):
    docs, asked = collections(spark)
    scan = rounded(rt.bm25_topk(asked, docs.repartition(5), 6))
    assert scan == rounded(rt.bm25_topk(asked, docs, 6, postings=rt.bm25_index(docs)))
    index = vectors(spark, 60, "chunk_id", 2).filter("chunk_id < 60").withColumn(
        "collection", F.concat(F.lit("c"), (F.col("chunk_id") % 3).cast("string")))
    both = asked.join(vectors(spark, 30, "query_id", 1).drop("collection"), "query_id")
    found = rounded(rt.hybrid_topk(both, index, docs, 4))
    monkeypatch.setattr(rt.sp, "weights", lambda *a, **k: None)
    assert rounded(rt.hybrid_topk(both, index, docs, 4)) == found
    assert {q for q, *_ in found} >= set(range(13))


@pytest.mark.parametrize("cell, first", [(16, 1), (16, 3), (1000, 1)])
def test_stored_postings_equal_all_scores(spark, tmp_path, cell, first):
    from corpuskit.operators.postings import Postings

    docs, asked = collections(spark)
    store = Postings(spark, str(tmp_path / "index"), buckets=8, cell_chunks=cell)
    store.append(docs.filter("chunk_id < 200").orderBy("chunk_id").coalesce(1))
    store.append(docs.filter("chunk_id >= 200").orderBy(F.length("text")).coalesce(1))
    want = rounded(rt.bm25_topk(asked, docs, 3, 1.7, 0.5))
    assert rounded(store.topk(asked, 3, 1.7, 0.5, first)) == want
    stats = {r.collection: (r.n_docs, r.avg_len) for r in store.stats().collect()}
    assert stats == {r.collection: (r.n_docs, r.avg_len) for r in rt.bm25_stats(rt.bm25_index(docs)).collect()}
    assert sorted(map(tuple, store.document_frequency().collect())) == sorted(
        map(tuple, rt.document_frequency(rt.bm25_index(docs)).filter("term <> ''").collect()))
    _, open_, skipped, _ = store.plan(asked, 3, 1.7, 0.5, first)
    if cell == 16:
        # Cells that cannot reach the third score are not read.
        assert skipped.count() > 0 and open_.count() > 0


def test_stored_postings_in_later_segments_alone(spark, tmp_path):
    from corpuskit.operators.postings import Postings

    store = Postings(spark, str(tmp_path / "index"), buckets=4)
    for i in range(3):
        store.append(spark.createDataFrame([(i, f"same words {'x' * i}")], "chunk_id long, text string"))
    q = spark.createDataFrame([(1, "same xx")], "query_id long, text string")
    assert [r.chunk_id for r in store.topk(q, 2).orderBy("rank").collect()] == [2, 0]


def test_stored_cells_belong_to_one_collection(spark, tmp_path, monkeypatch):
    from corpuskit.operators import postings

    monkeypatch.setattr(postings, "WORDS_AT_ONCE", 500)
    docs = spark.createDataFrame(
        [(i, None if i % 50 == 7 else " ".join(f"w{j % (i % 9 + 2)}" for j in range(i % 13)),
          None if i % 31 == 0 else f"c{i % 3}") for i in range(300)], "chunk_id long, text string, collection string")
    store = postings.Postings(spark, str(tmp_path / "index"), buckets=4, cell_chunks=16)
    store.append(docs.coalesce(2))
    cells = store.blocks().select("collection", "cell", F.explode("chunk_ids").alias("c")).groupBy("cell").agg(
        F.count_distinct("collection").alias("names"), F.count_distinct("c").alias("chunks"))
    most = cells.agg(F.max("names"), F.max("chunks")).first()
    # A chunk without words has no postings.
    assert most[0] == 1 and 8 < most[1] <= 16
    got = store.blocks().select("collection", "term", F.explode(F.arrays_zip("chunk_ids", "tfs", "lens")).alias("p"))
    want = rt.sp.counted(docs).select(
        "collection", F.explode(F.arrays_zip("terms", "tfs")).alias("t"), "chunk_id", "doc_len").select(
        "collection", "t.terms", "chunk_id", "t.tfs", "doc_len")
    assert got.select("collection", "term", "p.*").exceptAll(want).isEmpty()
    assert want.exceptAll(got.select("collection", "term", "p.*")).isEmpty()
    assert store.totals().agg(F.sum("n_docs")).first()[0] == 300


def test_multi_query_with_a_retriever(spark):
    q = spark.createDataFrame([(1, "find the cat now"), (2, " ")], "query_id long, text string")
    asked = []

    def retrieve(variants, k):
        asked.extend(variants.collect())
        return variants.select("query_id", F.col("query_id.variant").cast("long").alias("chunk_id"),
                               (1.0 / (1 + F.col("query_id.variant"))).alias("score"))

    hits = rt.multi_query_topk(q, None, 2, retrieve=retrieve).orderBy("rank").collect()
    assert [(h.query_id, h.chunk_id) for h in hits] == [(1, 0), (1, 1)] and len(asked) == 3


@pytest.mark.parametrize("query", ["graded_by_citations", "retrieval_findings"])
def test_a_search_with_several_readers_runs_once(spark, monkeypatch, query):
    from corpuskit.workload.vectors import BOOK

    rows, whole = spark.sparkContext.accumulator(0), rt.dense_topk

    def counting(*args, **more):
        def seen(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        hits = whole(*args, **more)
        return hits.mapInArrow(seen, hits.schema)

    monkeypatch.setattr(rt, "dense_topk", counting)
    BOOK.queries[query](spark, "/root/testdata/sf0.001").collect()
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert rows.value == vectors * (25 if query == "graded_by_citations" else 10)


def test_running_best_takes_only_candidates(monkeypatch):
    import numpy as np

    from corpuskit.operators import running

    rounded, np_round = [], np.round
    monkeypatch.setattr(running.np, "round", lambda x, n: (rounded.append(np.size(x)), np_round(x, n))[1])
    scores = np.random.default_rng(0).random((20, 5000))
    best, ids = running.Running(20, 3), np.arange(5000)
    for at in range(0, 5000, 500):
        best.add(scores[:, at:at + 500], ids[at:at + 500])
    query, found, _ = best.rows()
    assert sorted(zip(query, found)) == sorted((q, i) for q in range(20) for i in np.argsort(-scores[q])[:3])
    assert sum(rounded[1:]) < 20 * 5000 / 50
