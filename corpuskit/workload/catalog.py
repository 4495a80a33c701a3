"""Catalogue queries: orders as reports, line items as versions, customers as
owners, nations as collections, conversations as chat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import catalog as cat
from corpuskit.operators import evaluation as ev
from corpuskit.sources import files
from corpuskit.workload.common import Book, Tables
from corpuskit.workload.context import messages

BOOK = Book()


def reports(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("owner_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("Order of customer "), "o_custkey").alias("description"),
        F.concat(F.lit("author"), F.col("o_custkey") % 3).alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


def versions(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("version_number"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"), F.col("l_partkey").alias("checksum"))


_REPORTS = """
      reports AS (SELECT o_orderkey AS report_id, o_custkey AS owner_id, o_orderstatus AS status,
                    o_orderpriority AS title, 'Order of customer ' || o_custkey AS description,
                    'author' || (o_custkey % 3) AS author, o_orderdate AS created_at FROM orders),
      versions AS (SELECT l_orderkey AS report_id, l_linenumber AS version_number, l_shipdate AS created_at,
                    l_partkey AS checksum FROM lineitem)"""


@BOOK.add("report_search", f"""
      WITH {_REPORTS}
      SELECT report_id, owner_id, title FROM reports
      WHERE status = 'F' AND author = 'author1' AND (title ILIKE '%urgent%' OR description ILIKE '%7%')""")
def report_search(t: Tables) -> DataFrame:
    found = cat.list_reports(reports(t), status="F", author="author1", search="urgent")
    other = cat.list_reports(reports(t), status="F", author="author1", search="7")
    return found.unionByName(other).select("report_id", "owner_id", "title").distinct()


@BOOK.add("report_page", f"""
      WITH {_REPORTS}
      SELECT report_id, created_at, (SELECT count(*) FROM reports WHERE status = 'O') AS total
      FROM reports WHERE status = 'O' ORDER BY created_at DESC, report_id LIMIT 20 OFFSET 40""")
def report_page(t: Tables) -> DataFrame:
    found = cat.list_reports(reports(t), status="O").select("report_id", "created_at")
    return cat.page_of_rows(found, [F.col("created_at").desc(), F.col("report_id").asc()], 3, 20)


@BOOK.add("report_deep_page", f"""
      WITH {_REPORTS}
      SELECT report_id, created_at, (SELECT count(*) FROM reports) AS total
      FROM reports ORDER BY created_at DESC, report_id LIMIT 50
      OFFSET (SELECT (count(*) // 2 // 50) * 50 FROM reports)""")
def report_deep_page(t: Tables) -> DataFrame:
    """The page in the middle, found by partition counts."""
    found = reports(t).select("report_id", "created_at")
    middle = found.count() // 2 // 50
    return cat.page_of_rows(found, [F.col("created_at").desc(), F.col("report_id").asc()], middle + 1, 50, near_rows=0)


@BOOK.add("report_versions", f"""
      WITH {_REPORTS}
      SELECT r.report_id, r.status, v.version_number::BIGINT AS version_number, v.checksum
      FROM reports r LEFT JOIN versions v USING (report_id)""")
def report_versions(t: Tables) -> DataFrame:
    kept = versions(t).select("report_id", "version_number", "checksum")
    return cat.with_versions(reports(t).select("report_id", "status"), kept)


@BOOK.add("latest_version", f"""
      WITH {_REPORTS}
      SELECT report_id, version_number::BIGINT AS version_number, created_at, checksum FROM versions
      QUALIFY row_number() OVER (PARTITION BY report_id
        ORDER BY version_number DESC, created_at DESC, checksum DESC) = 1""")
def latest_version(t: Tables) -> DataFrame:
    return cat.latest_version(versions(t), ["created_at", "checksum"])


@BOOK.add("next_version", f"""
      WITH {_REPORTS}
      SELECT report_id, coalesce(max(version_number), 0)::BIGINT + 1 AS next_version
      FROM reports LEFT JOIN versions USING (report_id) GROUP BY report_id""")
def next_version(t: Tables) -> DataFrame:
    return cat.next_version(reports(t), versions(t))


@BOOK.add("count_by_status", f"WITH {_REPORTS} SELECT status, count(*) AS n FROM reports GROUP BY status")
def count_by_status(t: Tables) -> DataFrame:
    return cat.count_by(reports(t), "status")


@BOOK.add("equality_filter", f"""
      WITH {_REPORTS} SELECT report_id FROM reports WHERE status = 'P' AND title = '2-HIGH'""")
def equality_filter(t: Tables) -> DataFrame:
    return cat.equals(reports(t), status="P", title="2-HIGH").select("report_id")


# A report belongs to its owner's nation.
_LINKS = """
      links AS (SELECT c_nationkey::BIGINT AS collection_id, o_orderkey AS report_id
                FROM orders JOIN customer ON c_custkey = o_custkey)"""


def links(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").cast("bigint").alias("collection_id"), F.col("o_orderkey").alias("report_id"))


@BOOK.add("collection_reports", f"""
      WITH {_REPORTS}, {_LINKS}
      SELECT collection_id, count(*) AS n, min(created_at) AS first, count(*) FILTER (status = 'F') AS finished
      FROM links JOIN reports USING (report_id) GROUP BY collection_id""")
def collection_reports(t: Tables) -> DataFrame:
    return cat.collection_reports(links(t), reports(t)).groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first"),
        F.count_if(F.col("status") == "F").alias("finished"))


@BOOK.add("link_reports", f"""
      WITH {_LINKS}, added AS (SELECT DISTINCT (collection_id % 5)::BIGINT AS collection_id, report_id FROM links),
      gone AS (SELECT collection_id, report_id FROM links WHERE report_id % 3 = 0)
      SELECT * FROM (SELECT * FROM links UNION SELECT * FROM added) u WHERE NOT EXISTS (
        SELECT 1 FROM gone g WHERE g.collection_id = u.collection_id AND g.report_id = u.report_id)""")
def link_reports(t: Tables) -> DataFrame:
    known = links(t)
    more = known.withColumn("collection_id", F.col("collection_id") % 5)
    return cat.unlink(cat.link(known, more.unionByName(more)), known.filter(F.col("report_id") % 3 == 0))


@BOOK.add("owned_reports", f"""
      WITH {_REPORTS}, asked AS (SELECT o_custkey - o_custkey % 2 AS user_id, o_orderkey AS report_id,
             row_number() OVER (PARTITION BY o_custkey - o_custkey % 2 ORDER BY o_orderkey) AS position FROM orders)
      SELECT user_id, report_id, EXISTS (SELECT 1 FROM reports r
               WHERE r.report_id = a.report_id AND r.owner_id = a.user_id) AS granted FROM asked a""")
def owned_reports(t: Tables) -> DataFrame:
    asked = t.orders.select(
        (F.col("o_custkey") - F.col("o_custkey") % 2).alias("user_id"), F.col("o_orderkey").alias("report_id"))
    good, dropped = cat.owned_scope(asked, reports(t))
    return good.withColumn("granted", F.lit(True)).unionByName(dropped.withColumn("granted", F.lit(False)))


@BOOK.add("exact_duplicates", """
      WITH k AS (SELECT doc_id, sha256(text) AS checksum FROM documents)
      SELECT doc_id, checksum, min(doc_id) OVER (PARTITION BY checksum) AS first_id,
             count(*) OVER (PARTITION BY checksum) AS copies FROM k
      QUALIFY copies > 1""")
def exact_duplicates(t: Tables) -> DataFrame:
    return cat.duplicate_documents(t.text("documents"), "doc_id")


# --- chat -------------------------------------------------------------------

_SESSIONS = """
      sessions AS (SELECT conv_id AS session_id, conv_id % 10 AS user_id, conv_id % 7 = 0 AS archived,
                     max(turn) AS updated_at, CASE WHEN conv_id % 2 = 0 THEN 'so far' END AS summary
                   FROM conversations GROUP BY conv_id),
      counts AS (SELECT conv_id AS session_id, count(*) AS n FROM conversations GROUP BY conv_id)"""


def sessions(t: Tables) -> DataFrame:
    return t.conversations.groupBy(F.col("conv_id").alias("session_id")).agg(
        F.max("turn").alias("updated_at")).select(
        "session_id", (F.col("session_id") % 10).alias("user_id"),
        (F.col("session_id") % 7 == 0).alias("archived"), "updated_at",
        F.when(F.col("session_id") % 2 == 0, "so far").alias("summary"))


@BOOK.add("recent_sessions", f"""
      WITH {_SESSIONS}
      SELECT session_id, user_id, updated_at, n AS message_count,
             row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, session_id) AS recency
      FROM sessions JOIN counts USING (session_id) WHERE NOT archived QUALIFY recency <= 3""")
def recent_sessions(t: Tables) -> DataFrame:
    return cat.recent_sessions(sessions(t), messages(t), 3).select(
        "session_id", "user_id", "updated_at", "message_count", "recency")


@BOOK.add("message_page", """
      WITH m AS (SELECT conv_id AS session_id, turn AS position, role, max(turn) OVER (PARTITION BY conv_id) AS before
                 FROM conversations)
      SELECT session_id, position, role, row_number() OVER (PARTITION BY session_id ORDER BY position) AS n
      FROM m WHERE position < before QUALIFY n BETWEEN 2 AND 4""")
def message_page(t: Tables) -> DataFrame:
    rows = messages(t)
    anchors = rows.groupBy("session_id").agg(F.max("position").alias("before"))
    return cat.message_page(rows, anchors, limit=3, offset=1).select("session_id", "position", "role", "n")


for _name, _dir in (("history_oldest", "ASC"), ("history_newest", "DESC")):

    @BOOK.add(_name, f"""
      SELECT conv_id AS session_id, turn AS position, role FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn {_dir}) <= 4""")
    def _history(t: Tables, which: str = _name.split("_")[1]) -> DataFrame:
        return cat.history_window(messages(t), 4, which).select("session_id", "position", "role")


@BOOK.add("message_counts", "SELECT conv_id AS session_id, count(*) AS message_count FROM conversations GROUP BY 1")
def message_counts(t: Tables) -> DataFrame:
    return cat.message_counts(messages(t))


@BOOK.add("cascade_delete", f"""
      WITH {_SESSIONS}
      SELECT s.session_id, count(c.turn) AS messages FROM sessions s JOIN conversations c ON c.conv_id = s.session_id
      WHERE NOT archived GROUP BY 1""")
def cascade_delete(t: Tables) -> DataFrame:
    rows = sessions(t)
    left, said = cat.delete_sessions(rows, messages(t), rows.filter("archived"))
    return left.select("session_id").join(cat.message_counts(said), "session_id").withColumnRenamed(
        "message_count", "messages")


# Users' event streams as sessions with times: views ask, clicks answer.
@BOOK.add("session_stats", """
      WITH m AS (SELECT user_id AS session_id, ts, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant'
                   ELSE 'system' END AS role, event_id, (event_id % 50) AS tok, (event_id % 3) AS cit FROM events),
      p AS (SELECT *, lag(role) OVER w AS prole, lag(ts) OVER w AS pts FROM m
            WINDOW w AS (PARTITION BY session_id ORDER BY event_id))
      SELECT session_id, count(*) AS message_count, sum(tok)::BIGINT AS token_count, sum(cit)::BIGINT AS citation_count,
             coalesce(round(avg(CASE WHEN role = 'assistant' AND prole = 'user'
               THEN epoch_us(ts) / 1e6 - epoch_us(pts) / 1e6 END), 4), 0) AS average_response_time
      FROM p GROUP BY session_id""")
def session_stats(t: Tables) -> DataFrame:
    role = F.when(F.col("event_type") == "view", "user").when(F.col("event_type") == "click", "assistant").otherwise("system")
    rows = t.events.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("position"), role.alias("role"),
        F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 50).alias("token_count"),
        (F.col("event_id") % 3).alias("citation_count"))
    out = cat.session_statistics(rows)
    return out.withColumn("average_response_time", F.round("average_response_time", 4))


@BOOK.add("last_n_transcript", """
      WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
      SELECT conv_id AS session_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || left(text, 300),
               chr(10) ORDER BY turn) AS text FROM m WHERE r <= 5 GROUP BY conv_id""")
def last_n_transcript(t: Tables) -> DataFrame:
    return cat.transcript(messages(t), 5)


@BOOK.add("session_flags", f"""
      WITH {_SESSIONS}
      SELECT session_id, n >= 3 AND coalesce(summary, '') <> '' AS needs_rewrite, n >= 6 AS needs_summary
      FROM sessions JOIN counts USING (session_id)""")
def session_flags(t: Tables) -> DataFrame:
    return cat.session_flags(sessions(t), messages(t))


# --- evaluation runs --------------------------------------------------------

# Every order is one scored question; the customer's market segment is the run.
_RESULTS = """
      results AS (SELECT c_mktsegment AS run_id, (o_orderkey % 11) / 10 AS faithfulness, (o_orderkey % 7) / 6 AS relevance,
                    (o_orderkey % 5) / 4 AS citation_precision, o_totalprice AS latency_ms
                  FROM orders JOIN customer ON c_custkey = o_custkey)"""
_CARD = """
      card AS (SELECT run_id, count(*) AS num_queries, avg(faithfulness) AS faithfulness, avg(relevance) AS relevance,
                 avg(citation_precision) AS citation_precision, median(latency_ms) AS latency_p50,
                 list_sort(list(latency_ms))[floor(count(*) * 0.95)::BIGINT + 1] AS latency_p95
               FROM results GROUP BY run_id)"""


def results(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_mktsegment").alias("run_id"), (F.col("o_orderkey") % 11 / 10).alias("faithfulness"),
        (F.col("o_orderkey") % 7 / 6).alias("relevance"), (F.col("o_orderkey") % 5 / 4).alias("citation_precision"),
        F.col("o_totalprice").alias("latency_ms"))


@BOOK.add("eval_scorecard", f"""
      WITH {_RESULTS}, {_CARD}
      SELECT run_id, num_queries, round(faithfulness, 6) AS faithfulness, round(relevance, 6) AS relevance,
             round(citation_precision, 6) AS citation_precision, round(latency_p50, 6) AS latency_p50,
             round(latency_p95, 6) AS latency_p95,
             round((faithfulness + relevance + citation_precision) / 3 * 10, 6) AS overall FROM card""")
def eval_scorecard(t: Tables) -> DataFrame:
    return ev.eval_scorecard(results(t))


@BOOK.add("eval_run_rows", f"""
      WITH {_RESULTS}, {_CARD}
      SELECT run_id, round(faithfulness, 6) AS faithfulness, round(latency_p95, 6) AS latency_p95, num_queries AS num_results
      FROM card""")
def eval_run_rows(t: Tables) -> DataFrame:
    rows = results(t)
    runs = files.eval_run_rows(rows, ev.eval_scorecard(rows))
    return runs.select("run_id", F.col("metrics")["faithfulness"].alias("faithfulness"),
                       F.col("metrics")["latency_p95"].alias("latency_p95"), "num_results")


@BOOK.add("compare_runs", """
      WITH runs AS (SELECT o_orderkey AS run_id, o_orderstatus AS prompt_version, o_orderpriority AS model,
                      o_orderdate AS created_at, o_totalprice AS overall FROM orders),
      d AS (SELECT *, row_number() OVER w AS recency, overall - lead(overall) OVER w AS overall_delta FROM runs
            WINDOW w AS (PARTITION BY prompt_version, model ORDER BY created_at DESC, run_id DESC))
      SELECT run_id, prompt_version, model, created_at, overall, recency, round(overall_delta, 6) AS overall_delta
      FROM d WHERE recency <= 5""")
def compare_runs(t: Tables) -> DataFrame:
    runs = t.orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("prompt_version"),
        F.col("o_orderpriority").alias("model"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").alias("overall"))
    return ev.compare_runs(runs, ["prompt_version", "model"], 5)
