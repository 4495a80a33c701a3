"""Trace analytics over events: five consecutive events form one request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import catalog as cat
from corpuskit.operators import evaluation as ev
from corpuskit.operators import traces as tr
from corpuskit.workload.common import Book, Tables

BOOK = Book()

STAGES = ["click", "error", "purchase", "signup", "view"]


def rows(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"),
        F.col("value").alias("ms"), F.concat(F.lit("v"), F.col("user_id") % 2).alias("prompt_version"),
        F.concat(F.lit("m"), F.get_json_object("props", "$.k").cast("int") % 3).alias("model"),
        (F.col("event_type") == "error").alias("failed"))


_ROWS = """
      r AS (SELECT event_id, ts, event_type AS stage, value AS ms, 'v' || (user_id % 2) AS prompt_version,
              'm' || (json_extract(props, '$.k')::INT % 3) AS model, event_type = 'error' AS failed FROM events)"""


def wide(t: Tables) -> DataFrame:
    """One row per request, a column per stage."""
    request = F.expr("event_id div 5").alias("request_id")
    return t.events.groupBy(request).agg(
        F.max(F.col("ts").cast("timestamp")).alias("created_at"),
        *[F.coalesce(F.sum(F.when(F.col("event_type") == s, F.col("value"))), F.lit(0.0)).alias(f"{s}_ms")
          for s in STAGES])


_WIDE = "wide AS (SELECT event_id // 5 AS request_id, max(ts) AS created_at, " + ", ".join(
    f"coalesce(sum(value) FILTER (event_type = '{s}'), 0) AS {s}_ms" for s in STAGES
) + " FROM events GROUP BY 1)"
_COLUMNS = ", ".join(f"round({s}_ms, 6) AS {s}_ms" for s in STAGES)


@BOOK.add("trace_fold", f"""
      WITH {_WIDE}
      """ + " UNION ALL ".join(
    f"SELECT request_id, '{s}' AS stage, round({s}_ms, 6) AS ms FROM wide" for s in STAGES))
def trace_fold(t: Tables) -> DataFrame:
    return tr.stage_rows(tr.fold_stages(wide(t), STAGES)).select("request_id", "stage", "ms")


@BOOK.add("trace_unfold", f"WITH {_WIDE} SELECT request_id, created_at, {_COLUMNS} FROM wide")
def trace_unfold(t: Tables) -> DataFrame:
    return tr.unfold_stages(tr.fold_stages(wide(t), STAGES), STAGES)


@BOOK.add("trace_recent", f"""
      WITH {_WIDE} SELECT request_id, created_at, {_COLUMNS} FROM wide
      ORDER BY created_at DESC, request_id DESC LIMIT 25""")
def trace_recent(t: Tables) -> DataFrame:
    return tr.recent(wide(t), 25)


@BOOK.add("trace_latency", f"""
      WITH {_ROWS},
      g AS (SELECT prompt_version, model, stage, count(*) AS n, avg(ms) AS mean_ms, median(ms) AS p50_ms,
              list_sort(list(ms))[floor(count(*) * 0.95)::BIGINT + 1] AS p95_ms, sum(ms) AS s FROM r GROUP BY ALL)
      SELECT prompt_version, model, stage, n, round(mean_ms, 6) AS mean_ms, round(p50_ms, 6) AS p50_ms,
             round(p95_ms, 6) AS p95_ms, round(s / sum(s) OVER (PARTITION BY prompt_version, model), 6) AS share FROM g""")
def trace_latency(t: Tables) -> DataFrame:
    return tr.stage_latency(rows(t), ["prompt_version", "model"])


@BOOK.add("stage_rollup", f"""
      WITH {_ROWS}
      SELECT prompt_version, model, stage, grouping(prompt_version, model, stage)::BIGINT AS level, count(*) AS n,
             round(avg(ms), 6) AS mean_ms FROM r GROUP BY ROLLUP (prompt_version, model, stage)""")
def stage_rollup(t: Tables) -> DataFrame:
    return tr.stage_rollup(rows(t), ["prompt_version", "model", "stage"])


@BOOK.add("trace_usage", """
      SELECT 'v' || (user_id % 2) AS prompt_version, count(*) AS requests,
             round(avg((event_type = 'view')::INT), 6) AS cache_hit_rate, sum(event_id % 100)::BIGINT AS prompt_tokens,
             0::BIGINT AS completion_tokens, sum(event_id % 10)::BIGINT AS chunks_retrieved,
             sum(event_id % 4)::BIGINT AS chunks_cited,
             round(sum(event_id % 4) / sum(event_id % 10), 6) AS cited_share FROM events GROUP BY 1""")
def trace_usage(t: Tables) -> DataFrame:
    e = F.col("event_id")
    traces = t.events.select(
        F.concat(F.lit("v"), F.col("user_id") % 2).alias("prompt_version"),
        (F.col("event_type") == "view").alias("cache_hit"),
        F.create_map(F.lit("prompt_tokens"), e % 100, F.lit("chunks_retrieved"), e % 10,
                     F.lit("chunks_cited"), e % 4).alias("counts"))
    return tr.usage(traces, ["prompt_version"])


@BOOK.add("latency_summary", """
      SELECT event_type AS operation, count(*) AS n, round(avg(value), 6) AS mean_ms,
             round(stddev_samp(value), 6) AS stddev_ms, min(value) AS min_ms, max(value) AS max_ms,
             round(count(*) / (sum(value) / 1000), 6) AS per_second FROM events GROUP BY 1""")
def latency_summary(t: Tables) -> DataFrame:
    return ev.latency_summary(t.events.select(F.col("event_type").alias("operation"), F.col("value").alias("ms")))


WINDOWS = """
      SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start,
             time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, count(*) AS n,
             count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean_ms, max(value) AS max_ms
      FROM events GROUP BY ALL"""


@BOOK.add("trace_windows", WINDOWS)
def trace_windows(t: Tables) -> DataFrame:
    return tr.windows(rows(t))


# Event types as processing states of 500 reports.
STATUS = """
      SELECT event_id % 500 AS report_id, CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'processing'
               WHEN 'error' THEN 'failed' ELSE 'ready' END AS status, ts FROM events
      QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY ts DESC, event_id DESC) = 1"""


def status_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        (F.col("event_id") % 500).alias("report_id"),
        F.when(kind == "signup", "uploaded").when(kind == "view", "processing").when(kind == "error", "failed")
        .otherwise("ready").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


@BOOK.add("document_status", STATUS)
def document_status(t: Tables) -> DataFrame:
    return cat.latest_status(status_events(t.events))
