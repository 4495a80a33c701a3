"""The streaming jobs, run to the end of the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import embedding as emb
from corpuskit.plans.ingest import ingest
from corpuskit.session import fresh_path
from corpuskit.sources.index import read_index
from corpuskit.streaming import jobs
from corpuskit.workload.common import Book, Tables
from corpuskit.workload.traces import STATUS, WINDOWS, status_events

BOOK = Book()


def stream(t: Tables, name: str) -> DataFrame:
    """A given table as a file stream, be it one file or a folder of files.

    The path is written as a pattern, because a stream takes a single file only from one.
    """
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.dir}/{name}.parque[t]")


@BOOK.add("stream_trace_windows", f"""
      WITH w AS ({WINDOWS}) SELECT * FROM w
      WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'""")
def stream_trace_windows(t: Tables) -> DataFrame:
    """Windows the watermark has closed; the last ones stay open."""
    rows = stream(t, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ms"),
        (F.col("event_type") == "error").alias("failed"))
    out = fresh_path(t.spark, "windows")
    jobs.write_rows(jobs.trace_windows(rows), out, fresh_path(t.spark, "ckpt")).awaitTermination()
    return t.spark.read.parquet(out)


@BOOK.add("stream_status", STATUS)
def stream_status(t: Tables) -> DataFrame:
    out = fresh_path(t.spark, "status")
    jobs.status_table(status_events(stream(t, "events")), out, fresh_path(t.spark, "ckpt")).awaitTermination()
    return jobs.read_status(t.spark, out)


@BOOK.add("stream_suppress_repeats", """
      WITH RECURSIVE passed AS (
        SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY ALL
        UNION ALL
        SELECT e.user_id, e.event_type, min(e.ts) FROM passed p JOIN events e
          ON p.user_id = e.user_id AND p.event_type = e.event_type AND e.ts >= p.t + INTERVAL '1 hour'
        GROUP BY ALL)
      SELECT user_id, event_type, count(*) AS kept, max(t) AS last FROM passed GROUP BY ALL""")
def stream_suppress_repeats(t: Tables) -> DataFrame:
    """Each key passes again an hour after it last did."""
    rows = stream(t, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = fresh_path(t.spark, "first")
    jobs.write_rows(
        jobs.suppress_repeats(rows, ["user_id", "event_type"]), out, fresh_path(t.spark, "ckpt")).awaitTermination()
    return t.spark.read.parquet(out).groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("kept"), F.max("ts").alias("last"))


def _to_index(df: DataFrame) -> DataFrame:
    rows = ingest(
        df.select("doc_id", "text", "source"), emb.hashing_encoder(16),
        F.concat(F.lit("report_"), "source"), "hashing-16", "local", "fixed")
    return rows.select("collection", "chunk_id", "doc_id", "chunk_index", "text", "embedding")


@BOOK.add("stream_ingest")
def stream_ingest(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "index")
    jobs.stream_ingest(stream(t, "documents"), _to_index, path, fresh_path(t.spark, "ckpt")).awaitTermination()
    index = read_index(t.spark, path)
    return index.groupBy("collection").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"),
        F.sum(F.size("embedding")).alias("numbers"))


@BOOK.add("batch_ingest")
def batch_ingest(t: Tables) -> DataFrame:
    return _to_index(t.text("documents")).groupBy("collection").agg(
        F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc_id").alias("documents"),
        F.sum(F.size("embedding")).alias("numbers"))
