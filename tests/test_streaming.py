import json

from pyspark.sql import functions as F

from corpuskit.operators import embedding as emb
from corpuskit.plans.answering import prompts, retrieve
from corpuskit.plans.ingest import ingest
from corpuskit.sources.files import read_eval_sets, read_text_documents
from corpuskit.sources.index import read_index
from corpuskit.streaming import jobs
from corpuskit.workload.streams import BOOK


def to_index(df):
    rows = ingest(df, emb.hashing_encoder(8), F.lit("report_1"), strategy="recursive")
    return rows.select("collection", "chunk_id", "text", "embedding")


def test_stream_equals_batch_and_replay_adds_nothing(spark, tmp_path):
    docs = [(i, f"Document {i}. " + "Some words here. " * (i * 20)) for i in range(1, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # a second job without the first one's progress replays all
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(stream, to_index, str(tmp_path / "idx"), str(tmp_path / checkpoint)).awaitTermination()
        got = read_index(spark, str(tmp_path / "idx"), "report_1")
        assert got.count() == to_index(df).count() == got.select("chunk_id").distinct().count()


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    many = spark.createDataFrame(
        [(i, f"Document {i}. " + "Some words here. " * 40, f"s{i % 2}") for i in range(12)],
        "doc_id long, text string, source string")
    many.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "one").mkdir()
    many.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    for folder in (tmp_path, tmp_path / "one"):
        got = {q: sorted(map(tuple, BOOK.queries[q](spark, str(folder)).collect())) for q in ("stream_ingest", "batch_ingest")}
        assert got["stream_ingest"] == got["batch_ingest"] and sum(r[2] for r in got["batch_ingest"]) == 12


def test_files(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a_b.txt").write_text("one two\nthree ü\n", encoding="utf-8")
    (folder / "skip.bin").write_bytes(b"x")
    rows = read_text_documents(spark, str(folder)).collect()
    assert [(r.title, r.extension, r.line_count, r.word_count, r.char_count) for r in rows] == [
        ("a_b", ".txt", 2, 4, 16)]
    (tmp_path / "set.json").write_text(json.dumps({
        "document": "D", "document_path": "p", "topic": "t",
        "queries": [{"id": "q1", "query": "what", "expected_topics": ["x"], "expected_grounded": True}]}))
    row = read_eval_sets(spark, str(tmp_path / "set.json")).first()
    assert (row.query_id, row.text, row.topics, row.expected_grounded) == ("q1", "what", ["x"], True)


def test_answering_plan(spark):
    docs = [(i, f"chunk number {i} about topic{i % 4} and more text", f"s{i % 2}") for i in range(20)]
    corpus = emb.embed(
        spark.createDataFrame(docs, "chunk_id long, text string, source_id string"), emb.hashing_encoder(16)
    ).select("chunk_id", "text", "source_id", "embedding")
    corpus = corpus.select(
        F.col("chunk_id").cast("string").alias("chunk_id"), "text", "source_id", "embedding",
        F.lit("T").alias("source_title"), F.lit("").alias("section_name"), F.lit(1).alias("page_number"),
        F.array().cast("array<string>").alias("citations"), F.lit(None).cast("int").alias("token_count"))
    asked = emb.embed(spark.createDataFrame([(1, "topic3 text")], "query_id long, text string"), emb.hashing_encoder(16))
    queries = asked.select("query_id", "text", "embedding")
    hits = retrieve(queries, corpus, corpus.drop("embedding"), k=6, keep=3)
    rows, cited = prompts(hits, queries)
    out = rows.first()
    assert out.num_chunks == 3 and out.user_prompt.startswith("Query: topic3 text") and len(out.prompt_hash) == 16
    assert cited.count() == 3


def test_repeats_by_groups_of_keys(spark, tmp_path):
    rows = [(u, e, 60 * ((7 * i * (u + 1)) % 500)) for i in range(60) for u in range(4) for e in ("a", None)]
    made = spark.createDataFrame(rows, "user_id long, event_type string, minute long").selectExpr(
        "user_id", "event_type", "timestamp_seconds(minute) AS ts")
    path, (early, late) = str(tmp_path / "in"), (made.filter("minute(ts) % 2 = 0"), made.filter("minute(ts) % 2 = 1"))
    got, last = [], {}
    for part in (early, late):
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(made.schema).parquet(path)
        passed = jobs.suppress_repeats(stream, ["user_id", "event_type"], groups=2)
        jobs.write_rows(passed, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
        for u, e, at in sorted(map(tuple, part.collect()), key=lambda r: r[2]):
            if (u, e) not in last or (at - last[u, e]).total_seconds() >= 3600:
                last[u, e] = at
                got.append((u, e, at))
    out = spark.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r[0], r[1] or "", r[2])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(got, key=key)


def test_repeats_of_idle_keys_are_forgotten(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for minutes in ([0, 10], [200], [400]):
        df = spark.createDataFrame([(m // 100, 60 * m) for m in minutes], "k long, s long").selectExpr(
            "k", "timestamp_seconds(s) AS ts")
        df.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(df.schema).parquet(path)
        passed = jobs.suppress_repeats(stream, ["k"], idle="30 minutes", groups=1)
        query = jobs.write_rows(passed, str(tmp_path / "out"), str(tmp_path / "ckpt"))
        query.awaitTermination()
        seen.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert seen == [1, 2, 3]
