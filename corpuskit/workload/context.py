"""Context assembly, citations and prompts over BM25 hits; history over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import citations as ct
from corpuskit.operators import context as cx
from corpuskit.operators import quality as ql
from corpuskit.workload.common import Book, Tables
from corpuskit.workload.retrieval import bm25_sql, hits_with_text, top_sql

BOOK = Book()

# Thirty hits per query; the first five come back once more with half the score;
# some lack an id, a page, a parent or a citation.
CTX = f"""{bm25_sql()}, hits AS ({top_sql('bm', 30)}),
      h2 AS (SELECT query_id, chunk_id AS doc_id, round(score, 6) AS score, rank AS pos FROM hits
             UNION ALL SELECT query_id, chunk_id, round(score, 6) / 2, rank + 100 FROM hits WHERE rank <= 5),
      ctx AS (SELECT query_id, pos, CASE WHEN doc_id % 10 = 0 THEN '' ELSE 'c' || doc_id END AS chunk_id,
                text AS content, score, source AS source_id, 'Title ' || (doc_id % 2) AS source_title,
                'S' || (doc_id % 3) AS section_name, CASE WHEN doc_id % 4 > 0 THEN doc_id % 10 END AS page_number,
                CASE WHEN doc_id % 3 = 0 THEN ['x' || (doc_id % 5), 'y'] ELSE []::VARCHAR[] END AS citations,
                CASE WHEN doc_id % 5 = 0 THEN 'c' || (doc_id + 1) ELSE '' END AS parent_chunk_id,
                CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS token_count
              FROM h2 JOIN documents USING (doc_id))"""

_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r0 FROM ctx)"
_DEDUPED = """
      one AS (SELECT * FROM ranked QUALIFY row_number() OVER (
                PARTITION BY query_id, CASE WHEN chunk_id = '' THEN left(content, 80) ELSE chunk_id END ORDER BY r0) = 1),
      ded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r0) AS rank FROM one)"""
_SELECTED = """
      present AS (SELECT query_id, list(chunk_id) AS ids FROM ded GROUP BY query_id),
      par AS (SELECT ded.* EXCLUDE (citations), CASE WHEN parent_chunk_id <> '' AND NOT list_contains(ids, parent_chunk_id)
                THEN list_append(citations, 'parent:' || parent_chunk_id) ELSE citations END AS citations
              FROM ded JOIN present USING (query_id)),
      sel AS (SELECT * EXCLUDE (citations), CASE WHEN len(citations) = 0 AND score > 0 AND source_id <> ''
                THEN [source_id] ELSE citations END AS citations FROM par WHERE rank <= 15)"""
SELECTED = f"{CTX}, {_RANKED}, {_DEDUPED}, {_SELECTED}"


def retrieved(t: Tables) -> DataFrame:
    hits = hits_with_text(t, 30).withColumn("score", F.round("score", 6))
    again = hits.filter("rank <= 5").withColumn("score", F.col("score") / 2).withColumn("rank", F.col("rank") + 100)
    doc = F.col("chunk_id")
    return hits.unionByName(again).select(
        "query_id", F.col("rank").alias("pos"),
        F.when(doc % 10 == 0, "").otherwise(F.concat(F.lit("c"), doc)).alias("chunk_id"), "content", "score",
        F.col("source").alias("source_id"), F.concat(F.lit("Title "), doc % 2).alias("source_title"),
        F.concat(F.lit("S"), doc % 3).alias("section_name"),
        F.when(doc % 4 > 0, doc % 10).alias("page_number"),
        F.when(doc % 3 == 0, F.array(F.concat(F.lit("x"), doc % 5), F.lit("y")))
        .otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(doc % 5 == 0, F.concat(F.lit("c"), doc + 1)).otherwise("").alias("parent_chunk_id"),
        cx.tokens(F.col("content")).alias("token_count"))


def selected(t: Tables) -> DataFrame:
    return cx.select_context(retrieved(t))


_KEY = ["query_id", "rank", "chunk_id"]


@BOOK.add("sort_context", f"""
      WITH {CTX}, {_RANKED} SELECT query_id, r0 AS rank, chunk_id, pos FROM ranked""")
def sort_context(t: Tables) -> DataFrame:
    return cx.by_score(retrieved(t)).select(*_KEY, "pos")


@BOOK.add("dedupe_context", f"""
      WITH {CTX}, {_RANKED}, {_DEDUPED} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ded""")
def dedupe_context(t: Tables) -> DataFrame:
    return cx.remove_duplicates(cx.by_score(retrieved(t))).select(*_KEY, "score")


@BOOK.add("select_context", f"""
      WITH {SELECTED}
      SELECT query_id, rank, chunk_id, round(score, 6) AS score, citations FROM sel""")
def select_context(t: Tables) -> DataFrame:
    return selected(t).select(*_KEY, "score", "citations")


@BOOK.add("merge_adjacent", f"""
      WITH {CTX}, {_RANKED}, {_DEDUPED},
      flat AS (SELECT * EXCLUDE (source_id, source_title), 's' AS source_id, '' AS source_title FROM ded),
      m AS (SELECT *, CASE WHEN section_name = lag(section_name) OVER w THEN 0 ELSE 1 END AS brk
            FROM flat WINDOW w AS (PARTITION BY query_id ORDER BY rank)),
      i AS (SELECT *, sum(brk) OVER (PARTITION BY query_id ORDER BY rank) AS island FROM m),
      g AS (SELECT query_id, island, arg_min(chunk_id, rank) AS chunk_id, min(rank) AS r,
              string_agg(content, chr(10) ORDER BY rank) AS content, max(score) AS score,
              sum(token_count)::BIGINT AS token_count,
              arg_min(page_number, rank) FILTER (page_number IS NOT NULL) AS page_number,
              flatten(list(citations ORDER BY rank)) AS c FROM i GROUP BY ALL)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, chunk_id,
             md5(content) AS digest, round(score, 6) AS score, token_count, page_number,
             list_filter(c, lambda x, i: list_position(c, x) = i) AS citations FROM g""")
def merge_adjacent(t: Tables) -> DataFrame:
    rows = cx.remove_duplicates(cx.by_score(retrieved(t)))
    rows = rows.withColumn("source_id", F.lit("s")).withColumn("source_title", F.lit(""))
    return cx.merge_adjacent(rows).select(
        *_KEY, F.md5("content").alias("digest"), "score", "token_count", "page_number", "citations")


@BOOK.add("enrich_context", f"""
      WITH {SELECTED}
      SELECT query_id, rank, coalesce(page_number, 7) AS page_number, section_name,
             'v' || (query_id % 3) AS source_version, 'ward' AS owner FROM sel""")
def enrich_context(t: Tables) -> DataFrame:
    rows = selected(t).withColumn("source_version", F.lit("")).withColumn(
        "metadata", F.create_map(F.lit("owner"), F.lit("nobody"), F.lit("keep"), F.lit("1")))
    full = cx.enrich(rows, {
        "page_number": F.lit(7), "section_name": F.lit("unused"), "owner": F.lit("ward"),
        "report_version": F.concat(F.lit("v"), F.col("query_id") % 3)})
    return full.select("query_id", "rank", "page_number", "section_name", "source_version",
                       F.col("metadata")["owner"].alias("owner"))


@BOOK.add("single_document", f"""
      WITH {SELECTED}
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, chunk_id
      FROM sel""")
def single_document(t: Tables) -> DataFrame:
    return cx.assemble_single(selected(t)).select(*_KEY)


@BOOK.add("multi_document", f"""
      WITH {SELECTED},
      k AS (SELECT * FROM sel QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, rank) <= 2)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, chunk_id FROM k""")
def multi_document(t: Tables) -> DataFrame:
    return cx.assemble_multi(selected(t), 2).select(*_KEY)


@BOOK.add("comparison_interleave", f"""
      WITH {SELECTED},
      k AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, rank) AS turn,
              min(rank) OVER (PARTITION BY query_id, source_id) AS seen FROM sel)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY turn, seen) AS rank, chunk_id
      FROM k WHERE turn <= 8""")
def comparison_interleave(t: Tables) -> DataFrame:
    return cx.assemble_comparison(selected(t)).select(*_KEY)


_SUMMARY = f"""
      WITH {SELECTED},
      g AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS content, max(score) AS score,
              flatten(list(citations ORDER BY rank)) AS c FROM sel WHERE rank <= 5 GROUP BY query_id)
      SELECT query_id, md5(content) AS digest, round(score, 6) AS score, length(content) // 4 AS token_count,
             list_filter(c, lambda x, i: list_position(c, x) = i) AS citations FROM g"""


@BOOK.add("summary_context", _SUMMARY)
def summary_context(t: Tables) -> DataFrame:
    return cx.assemble_summary(selected(t)).select(
        "query_id", F.md5("content").alias("digest"), "score", "token_count", "citations")


_GROUND = cx.GROUNDING.replace("'", "''")


@BOOK.add("system_prompts", f"""
      WITH {SELECTED},
      s AS (SELECT query_id, '{_GROUND}' || chr(10) || 'The user is asking about: '
              || array_to_string(list_sort(list(DISTINCT source_title)), ', ') || '.' AS single,
              'You are a comparison analysis assistant. Compare and contrast the following sources: '
              || array_to_string(list_sort(list(DISTINCT source_id))[1:5], ', ') || '.' AS comparison,
              count(DISTINCT source_id) AS n FROM sel GROUP BY query_id),
      f AS (SELECT query_id, source_id, min(rank) AS r FROM sel GROUP BY ALL),
      m AS (SELECT query_id, array_to_string(list(source_id ORDER BY r), ', ') AS names FROM f GROUP BY query_id)
      SELECT query_id, single, comparison,
             'You are a helpful multi-document analysis assistant. The user is referencing: '
             || CASE WHEN n <= 3 THEN names ELSE n || ' documents' END || '.' AS multi
      FROM s JOIN m USING (query_id)""")
def system_prompts(t: Tables) -> DataFrame:
    rows = selected(t)
    return (
        cx.single_prompt(rows).withColumnRenamed("system_prompt", "single")
        .join(cx.comparison_prompt(rows).withColumnRenamed("system_prompt", "comparison"), "query_id")
        .join(cx.multi_prompt(rows).withColumnRenamed("system_prompt", "multi"), "query_id"))


# Each query's history: the conversation with its number.
_BUDGET = """
      tk AS (SELECT query_id, sum(token_count)::BIGINT AS c FROM sel GROUP BY query_id),
      hi AS (SELECT conv_id AS query_id, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS h,
               count(*) AS n_messages FROM conversations GROUP BY conv_id),
      bu AS (SELECT q.query_id, 8192 AS total, 150 AS system_prompt, 256 AS reserved,
               greatest(1, length(q.text) // 4) AS user_query, least(coalesce(h, 0), 1024) AS conversation_history,
               least(coalesce(c, 0), 6144) AS retrieved_chunks
             FROM queries q LEFT JOIN tk USING (query_id) LEFT JOIN hi USING (query_id)),
      bud AS (SELECT *, greatest(0, total - system_prompt - reserved - user_query - conversation_history
                - retrieved_chunks) AS metadata FROM bu),
      budget AS (SELECT *, system_prompt + reserved + user_query + conversation_history + retrieved_chunks + metadata
                AS allocated FROM bud)"""


def budgets(t: Tables, rows: DataFrame) -> DataFrame:
    history = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("text").alias("content"))
    return cx.allocate_budget(rows, t.text_queries(), history)


@BOOK.add("budget_allocate", f"""
      WITH {SELECTED}, {_BUDGET}
      SELECT query_id, total::BIGINT AS total, system_prompt::BIGINT AS system_prompt, reserved::BIGINT AS reserved,
             user_query, conversation_history, retrieved_chunks, metadata, allocated, total - allocated AS remaining
      FROM budget""")
def budget_allocate(t: Tables) -> DataFrame:
    return budgets(t, selected(t))


_FIT = """
      run AS (SELECT s.*, retrieved_chunks AS cap,
                coalesce(sum(token_count) OVER (PARTITION BY query_id ORDER BY rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used
              FROM sel s JOIN budget USING (query_id)),
      fst AS (SELECT query_id, min(rank) FILTER (used + token_count > cap) AS stop FROM run GROUP BY query_id),
      fit AS (SELECT query_id, rank, chunk_id, score, source_id, source_title, section_name, page_number, citations,
                CASE WHEN rank = stop THEN left(content, floor(length(content) * ((cap - used) / token_count))::BIGINT)
                  ELSE content END AS content,
                CASE WHEN rank = stop THEN cap - used ELSE token_count END AS token_count
              FROM run JOIN fst USING (query_id)
              WHERE stop IS NULL OR rank < stop OR (rank = stop AND cap - used > 64))"""


@BOOK.add("budget_enforce", f"""
      WITH {SELECTED}, {_BUDGET}, {_FIT}
      SELECT query_id, rank, chunk_id, md5(content) AS digest, token_count FROM fit""")
def budget_enforce(t: Tables) -> DataFrame:
    rows = selected(t)
    return cx.enforce_budget(rows, budgets(t, rows)).select(
        *_KEY, F.md5("content").alias("digest"), "token_count")


@BOOK.add("truncate_chunks", f"""
      WITH {CTX}, {_RANKED},
      run AS (SELECT *, coalesce(sum(token_count) OVER (PARTITION BY query_id ORDER BY r0
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM ranked),
      fst AS (SELECT query_id, min(r0) FILTER (used + token_count > 1286) AS stop FROM run GROUP BY query_id)
      SELECT query_id, r0 AS rank, chunk_id, md5(CASE WHEN r0 = stop THEN left(content, (1286 - used) * 4)
               ELSE content END) AS digest
      FROM run JOIN fst USING (query_id) WHERE stop IS NULL OR r0 < stop OR (r0 = stop AND (1286 - used) * 4 > 80)""")
def truncate_chunks(t: Tables) -> DataFrame:
    return cx.truncate_chunks(retrieved(t)).select(*_KEY, F.md5("content").alias("digest"))


@BOOK.add("context_text", f"""
      WITH {SELECTED},
      run AS (SELECT s.query_id, rank, content, text AS q, length(text) // 4 + sum(length(content) // 4) OVER (
                PARTITION BY s.query_id ORDER BY rank) AS used FROM sel s JOIN queries q USING (query_id)),
      p AS (SELECT query_id, string_agg('---' || chr(10) || content || chr(10), '' ORDER BY rank) AS body
            FROM run WHERE used <= 4000 GROUP BY query_id)
      SELECT query_id, md5('## Context for: ' || text || chr(10) || chr(10) || coalesce(body, '')) AS digest
      FROM queries LEFT JOIN p USING (query_id)""")
def context_text(t: Tables) -> DataFrame:
    return cx.build_context_text(selected(t), t.text_queries()).select("query_id", F.md5("text").alias("digest"))


@BOOK.add("full_text", f"""
      WITH {SELECTED},
      p AS (SELECT query_id, string_agg('Chunk ' || rank || CASE WHEN section_name <> '' THEN ' [' || section_name || ']' ELSE '' END
              || CASE WHEN page_number IS NOT NULL THEN ' (p. ' || page_number || ')' ELSE '' END || ': ' || content,
              chr(10) || chr(10) ORDER BY rank) AS body FROM sel GROUP BY query_id)
      SELECT query_id, md5('Query: ' || text || coalesce(chr(10) || chr(10) || body, '')) AS digest
      FROM queries LEFT JOIN p USING (query_id)""")
def full_text(t: Tables) -> DataFrame:
    return cx.render_full_text(selected(t), t.text_queries()).select("query_id", F.md5("text").alias("digest"))


@BOOK.add("context_stats", f"""
      WITH {SELECTED}, {_BUDGET}, {_FIT}, n AS (SELECT query_id, count(*) AS n FROM fit GROUP BY query_id)
      SELECT query_id, coalesce(n, 0) AS context_size, allocated AS token_usage,
             round(coalesce(n_messages, 0) / 20, 6) AS history_utilization,
             round(coalesce(n, 0) / 15, 6) AS retrieval_utilization
      FROM budget LEFT JOIN n USING (query_id) LEFT JOIN hi USING (query_id)""")
def context_stats(t: Tables) -> DataFrame:
    rows = selected(t)
    shares = budgets(t, rows)
    said = t.conversations.groupBy(F.col("conv_id").alias("query_id")).agg(F.count(F.lit(1)).alias("n"))
    return cx.context_stats(cx.enforce_budget(rows, shares), shares, said)


@BOOK.add("context_findings", f"""
      WITH {CTX}, {_RANKED}, k AS (SELECT * FROM ranked WHERE r0 <= 15),
      found AS (
        SELECT query_id, 'duplicate' AS check_name, 'warning' AS severity FROM (
          SELECT query_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY r0) > 1)
        UNION ALL SELECT query_id, 'missing_source', 'warning' FROM k WHERE r0 % 7 = 0
        UNION ALL SELECT query_id, 'over_budget', 'warning' FROM queries WHERE query_id % 2 = 0
        UNION ALL SELECT query_id, 'broken_parent', 'warning' FROM k WHERE parent_chunk_id <> '' AND NOT EXISTS (
          SELECT 1 FROM k o WHERE o.query_id = k.query_id AND o.chunk_id = k.parent_chunk_id))
      SELECT query_id, check_name, severity, count(*) AS n FROM found GROUP BY ALL""")
def context_findings(t: Tables) -> DataFrame:
    rows = cx.by_score(retrieved(t)).filter("rank <= 15").withColumn(
        "source_id", F.when(F.col("rank") % 7 == 0, "").otherwise(F.col("source_id"))).withColumn(
        "citations", F.when(F.col("parent_chunk_id") != "", F.array(
            F.concat(F.lit("parent:"), "parent_chunk_id"))).otherwise(F.col("citations")))
    totals = t.text_queries().select(
        "query_id", F.lit(100).alias("total"),
        F.when(F.col("query_id") % 2 == 0, 101).otherwise(100).alias("allocated"))
    found = ql.context_findings(rows, totals)
    return found.groupBy("query_id", "check_name", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- citations and prompts --------------------------------------------------

_CITED = f"""
      WITH {CTX}, {_RANKED},
      one AS (SELECT *, CASE WHEN chunk_id = '' THEN source_id ELSE chunk_id END AS ck FROM ranked
              QUALIFY row_number() OVER (PARTITION BY query_id, ck ORDER BY score DESC, r0) = 1),
      cit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0) AS citation_rank
              FROM one QUALIFY citation_rank <= 10)
      SELECT query_id, citation_rank, source_id AS report_id, source_title AS report_title, page_number,
             section_name, chunk_id, round(score, 6) AS score, md5(content) AS digest FROM cit"""


def _cited(t: Tables) -> DataFrame:
    return ct.extract_citations(cx.by_score(retrieved(t)))


@BOOK.add("extract_citations", _CITED)
def extract_citations(t: Tables) -> DataFrame:
    return _cited(t).withColumn("digest", F.md5("content")).drop("content")


@BOOK.add("citations_round_trip", _CITED)
def citations_round_trip(t: Tables) -> DataFrame:
    """To JSON and back again."""
    back = ct.citations_from_json(ct.citations_to_json(_cited(t)))
    return back.withColumn("digest", F.md5("content")).drop("content")


@BOOK.add("unique_citations", f"""
      WITH {SELECTED}, g AS (SELECT query_id, flatten(list(citations ORDER BY rank)) AS c FROM sel GROUP BY query_id)
      SELECT query_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS citations FROM g""")
def unique_citations(t: Tables) -> DataFrame:
    return ct.unique_citations(selected(t))


@BOOK.add("render_prompts", f"""
      WITH {SELECTED},
      p AS (SELECT query_id, count(*) AS num_chunks, string_agg('[Chunk ' || rank || '] (' || section_name || ') — ' || source_title
              || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS body FROM sel GROUP BY query_id),
      r AS (SELECT query_id, 'Answer.' || chr(10) || '---' || chr(10) || 'Strategy: single_document' || chr(10)
              || 'Context chunks: ' || num_chunks AS system_prompt,
              'Query: ' || text || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || body AS user_prompt, num_chunks
            FROM queries JOIN p USING (query_id))
      SELECT query_id, system_prompt, md5(user_prompt) AS user_digest, num_chunks,
             left(sha256(system_prompt || chr(10) || user_prompt), 16) AS prompt_hash FROM r""")
def render_prompts(t: Tables) -> DataFrame:
    queries = t.text_queries().withColumn("system_prompt", F.lit("Answer."))
    out = ct.render_prompts(selected(t), queries, "single_document")
    return out.select("query_id", "system_prompt", F.md5("user_prompt").alias("user_digest"), "num_chunks", "prompt_hash")


@BOOK.add("format_excerpts", f"""
      WITH {SELECTED}
      SELECT query_id, md5(string_agg('[' || rank || '] (relevance: ' || format('{{:.2f}}', score) || ')' || chr(10) || content,
               chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS digest
      FROM sel WHERE rank <= 5 GROUP BY query_id""")
def format_excerpts(t: Tables) -> DataFrame:
    return ct.format_excerpts(selected(t), 5).select("query_id", F.md5("text").alias("digest"))


@BOOK.add("citation_findings", f"""
      WITH {SELECTED},
      a AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN 'see TITLE 1 there' ELSE 'nothing' END AS answer FROM queries),
      c AS (SELECT query_id, source_title AS report_title FROM sel WHERE query_id % 5 > 0),
      f AS (SELECT query_id, report_title, 'title_not_found' AS check_name FROM c JOIN a USING (query_id)
              WHERE NOT contains(lower(answer), lower(report_title))
            UNION ALL SELECT query_id, NULL, 'no_citations' FROM a WHERE query_id % 5 = 0)
      SELECT query_id, report_title, check_name, count(*) AS n FROM f GROUP BY ALL""")
def citation_findings(t: Tables) -> DataFrame:
    answers = t.text_queries().select("query_id", F.when(
        F.col("query_id") % 2 == 0, "see TITLE 1 there").otherwise("nothing").alias("answer"))
    cited = selected(t).filter(F.col("query_id") % 5 > 0).select(
        "query_id", F.col("source_title").alias("report_title"))
    found = ql.citation_findings(cited, answers)
    return found.groupBy("query_id", "report_title", "check_name").agg(F.count(F.lit(1)).alias("n"))


# --- conversation history ---------------------------------------------------


def messages(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("position"), "role", F.col("text").alias("content"))


_TOK = "(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)"


@BOOK.add("trim_history", f"""
      WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
                   sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations)
      SELECT conv_id AS session_id, turn AS position, role FROM m WHERE n <= 3 OR used <= 200""")
def trim_history(t: Tables) -> DataFrame:
    return cx.trim_history(messages(t), 3, 200).select("session_id", "position", "role")


@BOOK.add("history_summary", """
      WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
      p AS (SELECT conv_id, i, CASE WHEN i % 2 = 1 THEN role || ': ' ELSE '' END || left(text, 200) AS piece
            FROM m WHERE i <= n - 3)
      SELECT conv_id AS session_id, string_agg(piece, ' | ' ORDER BY i) AS text,
             sum(length(piece) // 4)::BIGINT AS token_count, count(*) AS message_count FROM p GROUP BY conv_id""")
def history_summary(t: Tables) -> DataFrame:
    return cx.history_summary(messages(t), 3)


@BOOK.add("history_pieces", """
      WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
      SELECT conv_id AS session_id, i AS number,
        CASE WHEN i % 2 = 1 THEN role || ': ' ELSE '' END || left(text, 200) AS piece FROM m WHERE i <= n - 3""")
def history_pieces(t: Tables) -> DataFrame:
    return cx.history_pieces(messages(t), 3)


@BOOK.add("message_findings", """
      SELECT conv_id || '/' || turn AS entity_id, 'empty_message' AS check_name, 'error' AS severity
      FROM conversations WHERE turn = 3
      UNION ALL SELECT conv_id || '/' || turn, 'too_long', 'error' FROM conversations WHERE turn <> 3 AND length(text) > 400""")
def message_findings(t: Tables) -> DataFrame:
    rows = messages(t).select(
        F.concat_ws("/", "session_id", "position").alias("message_id"),
        F.when(F.col("position") == 3, " \t").otherwise(F.col("content")).alias("content"))
    return ql.message_findings(rows, "message_id", limit=400)


@BOOK.add("session_findings", """
      WITH s AS (SELECT DISTINCT conv_id, ['single', 'multi', 'comparison', 'other'][conv_id % 4 + 1] AS mode,
                   conv_id % 7 = 0 AS archived FROM conversations)
      SELECT conv_id AS entity_id, 'invalid_mode' AS check_name, 'error' AS severity FROM s WHERE mode = 'other'
      UNION ALL SELECT conv_id, 'archived', 'error' FROM s WHERE archived""")
def session_findings(t: Tables) -> DataFrame:
    modes = F.array(*[F.lit(m) for m in ("single", "multi", "comparison", "other")])
    sessions = t.conversations.select("conv_id").distinct().select(
        "conv_id", F.get(modes, (F.col("conv_id") % 4).cast("int")).alias("mode"),
        (F.col("conv_id") % 7 == 0).alias("archived"))
    return ql.session_findings(sessions, "conv_id")


@BOOK.add("answer_findings", """
      WITH a AS (SELECT conv_id * 100 + turn AS query_id, CASE WHEN turn = 5 THEN '' ELSE text || ' src_' || (turn % 2) END
                   AS answer, length(text) AS completion_tokens FROM conversations WHERE role = 'assistant')
      SELECT query_id, NULL::VARCHAR AS citation, 'empty_answer' AS check_name, 'error' AS severity FROM a WHERE answer = ''
      UNION ALL SELECT query_id, NULL, 'token_limit', 'warning' FROM a WHERE completion_tokens > 300
      UNION ALL SELECT query_id, 'src_1', 'citation_absent', 'warning' FROM a WHERE NOT contains(lower(answer), 'src_1')""")
def answer_findings(t: Tables) -> DataFrame:
    answers = t.conversations.filter("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
        F.when(F.col("turn") == 5, "").otherwise(
            F.concat("text", F.lit(" src_"), F.col("turn") % 2)).alias("answer"),
        F.length("text").alias("completion_tokens"))
    cited = answers.select("query_id", F.lit("src_1").alias("citation")).unionByName(
        answers.select("query_id", F.lit("plain").alias("citation")))
    return ql.answer_findings(answers, cited, max_tokens=300)


@BOOK.add("judge_score", """
      WITH a AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN ' yes, ' || text WHEN 1 THEN 'No.' WHEN 2 THEN 'score 0.' || (conv_id % 10)
                   WHEN 3 THEN 'about 1.7' ELSE 'unclear' END AS verdict FROM conversations)
      SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN (conv_id % 10) / 10
             WHEN 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM a""")
def judge_score(t: Tables) -> DataFrame:
    from corpuskit.operators.evaluation import judge_score as score

    kind = F.col("turn") % 5
    verdict = (
        F.when(kind == 0, F.concat(F.lit(" yes, "), "text")).when(kind == 1, "No.")
        .when(kind == 2, F.concat(F.lit("score 0."), F.col("conv_id") % 10)).when(kind == 3, "about 1.7")
        .otherwise("unclear"))
    return t.conversations.select("conv_id", "turn", score(verdict).alias("score"))
