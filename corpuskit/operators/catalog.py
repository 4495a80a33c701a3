"""Relational queries over reports, versions, collections, sessions and messages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators.ordered import top_rows, with_neighbour
from corpuskit.operators.skew import join_copies
from corpuskit.session import kept_table


# --- reports ----------------------------------------------------------------


def list_reports(
    reports: DataFrame, owner: Column | None = None, status: str | None = None,
    author: str | None = None, search: str | None = None,
) -> DataFrame:
    """Filters are combined with AND; ``search`` looks in title and description."""
    if owner is not None:
        reports = reports.filter(F.col("owner_id") == owner)
    if status is not None:
        reports = reports.filter(F.col("status") == status)
    if author is not None:
        reports = reports.filter(F.col("author") == author)
    if search is not None:
        like = f"%{search}%"
        reports = reports.filter(F.col("title").ilike(like) | F.col("description").ilike(like))
    return reports


# Rows up to this offset are found by keeping the first ones of each task; beyond it the order is laid out.
NEAR_ROWS = 10_000


def page_of_rows(
    df: DataFrame, order: Sequence[Column], page: int, size: int, near_rows: int = NEAR_ROWS,
) -> DataFrame:
    """One page (from 1) in a total order, with ``total`` = rows over all pages."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = (page - 1) * size
    if first + size <= near_rows:
        rows = df.orderBy(*order).offset(first).limit(size)
    else:
        rows = rows_between(df, order, first, first + size)
    return rows.withColumn("total", total)


def rows_between(df: DataFrame, order: Sequence[Column], first: int, last: int) -> DataFrame:
    """Rows number ``first`` to ``last`` - 1 (from 0) of a total order, however deep.

    The rows are dealt by ranges of the order and written in order; the partitions'
    counts, one number each, say in which of them the wanted rows lie, and only
    those are numbered.
    """
    laid = kept_table(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "ordered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit(2 ** 33 - 1))
    wanted, start = [], 0
    for number, n in sorted(laid.groupBy(part.alias("part")).count().collect()):
        low, high = max(first - start, 0), min(last - start, n)
        if low < high:
            wanted.append((part == number) & (at >= low) & (at < high))
        start += n
    keep = reduce(or_, wanted, F.lit(False))
    return laid.filter(keep).orderBy("_at").drop("_at")


def with_versions(reports: DataFrame, versions: DataFrame) -> DataFrame:
    """Each report with its versions as rows; reports without versions stay.

    Kept flat, so that a report with very many versions is not one huge row.
    """
    return reports.join(versions, "report_id", "left")


def latest_version(versions: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """The row with the highest version number of each report, pre-aggregated map-side."""
    rest = [c for c in versions.columns if c not in ("report_id", "version_number", *tie)]
    row = F.struct("version_number", *tie, *rest)
    best = versions.groupBy("report_id").agg(F.max(row).alias("_v"))
    return best.select("report_id", *[f"_v.{c}" for c in ("version_number", *tie, *rest)])


def next_version(reports: DataFrame, versions: DataFrame) -> DataFrame:
    top = versions.groupBy("report_id").agg(F.max("version_number").alias("_m"))
    return reports.select("report_id").join(top, "report_id", "left").select(
        "report_id", (F.coalesce("_m", F.lit(0)) + 1).alias("next_version"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def equals(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def collection_reports(links: DataFrame, reports: DataFrame) -> DataFrame:
    return links.select("collection_id", "report_id").join(reports, "report_id")


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Add links; known ones are left alone."""
    pair = ["collection_id", "report_id"]
    return links.select(*pair).unionByName(
        new.select(*pair).distinct().join(links.select(*pair), pair, "left_anti"))


def unlink(links: DataFrame, gone: DataFrame) -> DataFrame:
    pair = ["collection_id", "report_id"]
    return links.join(gone.select(*pair), pair, "left_anti")


def owned_scope(requests: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(granted, dropped) of the requested (user_id, report_id, position) rows."""
    own = reports.select(F.col("owner_id").alias("user_id"), "report_id")
    keys = ["user_id", "report_id"]
    return requests.join(own, keys, "left_semi"), requests.join(own, keys, "left_anti")


def duplicate_documents(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows whose content occurs more than once: key, checksum, first_id, copies."""
    keyed = df.select(key, F.sha2(text, 256).alias("checksum"))
    groups = keyed.groupBy("checksum").agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_id")).filter(F.col("copies") > 1)
    return join_copies(keyed, groups, ["checksum"], groups.select("checksum", "copies"))


# --- sessions and messages --------------------------------------------------


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))


def recent_sessions(
    sessions: DataFrame, messages: DataFrame, n: int = 50, include_archived: bool = False, offset: int = 0
) -> DataFrame:
    """Of each user's sessions, newest first, ``n`` after ``offset``, with their message counts.

    The list is cut before the count, so that only listed sessions are joined.
    """
    shown = sessions if include_archived else sessions.filter(~F.col("archived"))
    newest = top_rows(
        shown, ["user_id"], [F.col("updated_at").desc(), F.col("session_id").asc()], offset + n, "recency")
    newest = newest.filter(F.col("recency") > offset)
    return newest.join(message_counts(messages), "session_id", "left").withColumn(
        "message_count", F.coalesce("message_count", F.lit(0)))


def message_page(
    messages: DataFrame, anchors: DataFrame | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """Oldest messages first; with ``anchors`` (session_id, before) only earlier ones."""
    if anchors is not None:
        counted = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("copies"))
        messages = join_copies(messages, anchors, ["session_id"], counted).filter(
            F.col("position") < F.col("before")).drop("before")
    rows = top_rows(messages, ["session_id"], [F.col("position").asc()], offset + limit, "n")
    return rows.filter(F.col("n") > offset)


def history_window(messages: DataFrame, n: int = 50, which: str = "oldest") -> DataFrame:
    """At most ``n`` messages per session: the oldest (default) or the newest."""
    order = F.col("position").asc() if which == "oldest" else F.col("position").desc()
    return top_rows(messages, ["session_id"], [order], n, "n").drop("n")


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without the deleted sessions."""
    ids = gone.select("session_id")
    return sessions.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti")


def session_statistics(messages: DataFrame, block: Column | None = None) -> DataFrame:
    """Messages, tokens, citations and mean seconds from a question to its answer.

    ``messages``: session_id, position, role, created_at, token_count, citation_count.
    """
    seen = with_neighbour(
        messages, ["session_id"], "position", ["role", "created_at"], "_before", step=-1, block=block)
    wait = F.when(
        (F.col("role") == "assistant") & (F.col("_before.role") == "user"),
        F.col("created_at").cast("double") - F.col("_before.created_at").cast("double"))
    return seen.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.sum("token_count").alias("token_count"),
        F.sum("citation_count").alias("citation_count"),
        F.coalesce(F.avg(wait), F.lit(0.0)).alias("average_response_time"))


def transcript(messages: DataFrame, n: int = 10, chars: int = 300) -> DataFrame:
    """session_id, text: the last ``n`` messages as ``User:`` / ``Assistant:`` lines."""
    last = top_rows(messages, ["session_id"], [F.col("position").desc()], n, "_r")
    who = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    line = F.concat(who, F.substring("content", 1, chars))
    rows = last.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("_l"))
    return rows.select("session_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def session_flags(sessions: DataFrame, messages: DataFrame, rewrite_at: int = 3, summary_at: int = 6) -> DataFrame:
    """needs_rewrite: enough history and a summary; needs_summary: a longer history."""
    counts = message_counts(messages)
    n = F.coalesce("message_count", F.lit(0))
    return sessions.join(counts, "session_id", "left").select(
        "session_id",
        ((n >= rewrite_at) & ~tx.is_blank(F.col("summary"))).alias("needs_rewrite"),
        (n >= summary_at).alias("needs_summary"))


# --- processing status ------------------------------------------------------

# fixed values: states of a report, in order
STATUSES = ("uploaded", "processing", "ready", "failed")


def latest_status(events: DataFrame) -> DataFrame:
    """Latest status per report: report_id, status, ts.  Input: report_id, status, ts, seq."""
    last = events.groupBy("report_id").agg(F.max(F.struct("ts", "seq", "status")).alias("_s"))
    return last.select("report_id", F.col("_s.status").alias("status"), F.col("_s.ts").alias("ts"))
