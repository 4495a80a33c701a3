"""Chunking and chunk checks over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import chunking as ch
from corpuskit.operators import quality as ql
from corpuskit.workload.common import Book, Tables
from corpuskit.workload.text import DECORATED, PAGED, decorated, paged

BOOK = Book()


def _cut(sep: str) -> str:
    return f"WHEN instr(w, {sep}) > 0 THEN s + length(w) - instr(reverse(w), {sep}) + 1"


# Fixed windows as a recursion over (document, start).
FIXED = rf"""
      span AS (
        SELECT doc_id, 0::BIGINT AS s, 0::BIGINT AS e, 0 AS step FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, s,
          CASE WHEN s + 1000 >= n THEN n
            {_cut("chr(10) || chr(10)")} {_cut("chr(10)")} {_cut("'.'")} {_cut("' '")}
            ELSE s + 1000 END, step + 1
        FROM (SELECT p.doc_id, p.step, length(d.text) AS n,
                CASE WHEN p.step = 0 THEN 0 WHEN p.e - 200 > p.s THEN p.e - 200 ELSE p.e END AS s,
                substr(d.text, (CASE WHEN p.step = 0 THEN 0 WHEN p.e - 200 > p.s THEN p.e - 200 ELSE p.e END)::BIGINT + 1,
                       1000) AS w
              FROM span p JOIN documents d USING (doc_id)) WHERE s < n),
      body AS (SELECT doc_id, s AS start_offset, e AS end_offset, step,
                 regexp_replace(substr(d.text, s + 1, e - s), '^\s+|\s+$', '', 'g') AS text
               FROM span JOIN documents d USING (doc_id) WHERE step > 0),
      chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS chunk_index,
                   text, start_offset, end_offset, greatest(1, length(text) // 4) AS token_count
                 FROM body WHERE text <> '')"""


def _docs(t: Tables) -> DataFrame:
    return t.text("documents").select("doc_id", "text")


@BOOK.add("chunk_fixed", f"""
      WITH RECURSIVE {FIXED}
      SELECT doc_id, chunk_index, md5(text) AS digest, start_offset, end_offset, token_count FROM chunks""")
def chunk_fixed(t: Tables) -> DataFrame:
    return ch.chunk(_docs(t), "fixed").select(
        "doc_id", "chunk_index", F.md5("text").alias("digest"), "start_offset", "end_offset", "token_count")


@BOOK.add("chunk_overlap", f"""
      WITH RECURSIVE {FIXED},
      n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS ahead FROM chunks),
      o AS (SELECT doc_id, chunk_index, CASE WHEN ahead IS NULL THEN text
              ELSE text || chr(10) || chr(10) || left(ahead, 200) END AS text FROM n)
      SELECT doc_id, chunk_index, md5(text) AS digest, greatest(1, length(text) // 4) AS token_count FROM o""")
def chunk_overlap(t: Tables) -> DataFrame:
    chunks = ch.chunk(_docs(t), "fixed").select("doc_id", "chunk_index", "text")
    return ch.overlap_rows(chunks).select(
        "doc_id", "chunk_index", F.md5("text").alias("digest"), "token_count")


@BOOK.add("chunk_pages", f"""
      WITH RECURSIVE {FIXED}, {PAGED},
      ends AS (SELECT doc_id, page, sum(length(body)) OVER (PARTITION BY doc_id ORDER BY page) AS upto FROM pg)
      SELECT doc_id, chunk_index, coalesce(
        (SELECT min(page) FROM ends e WHERE e.doc_id = c.doc_id AND c.start_offset < e.upto), 3)::BIGINT AS page_number
      FROM chunks c""")
def chunk_pages(t: Tables) -> DataFrame:
    """Pages are longer than the clean text; the estimate compares the two as they are."""
    pages = paged(t).select("doc_id", F.split("text", "\f").alias("pages"))
    docs = _docs(t).join(pages, "doc_id")
    return ch.chunk(docs, "fixed").select("doc_id", "chunk_index", "page_number")


_STATS = """count(*) AS number_of_chunks, round(avg(length(text)), 6) AS average_chunk_size,
        max(length(text)) AS largest_chunk, min(length(text)) AS smallest_chunk,
        round(avg(token_count), 6) AS average_tokens, round(stddev_samp(length(text)), 6) AS size_stddev"""


@BOOK.add("chunk_statistics", f"""
      WITH RECURSIVE {FIXED} SELECT doc_id, {_STATS} FROM chunks GROUP BY doc_id""")
def chunk_statistics(t: Tables) -> DataFrame:
    return ch.chunk_statistics(ch.chunk(_docs(t), "fixed"))


@BOOK.add("inherit_metadata", f"""
      WITH RECURSIVE {FIXED}
      SELECT c.doc_id, source, lang, count(*) AS n FROM chunks c JOIN documents USING (doc_id) GROUP BY ALL""")
def inherit_metadata(t: Tables) -> DataFrame:
    docs = t.text("documents").select("doc_id", "text", "source", "lang")
    return ch.chunk(docs, "fixed").groupBy("doc_id", "source", "lang").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("merge_tiny_texts", """
      WITH parts AS (SELECT doc_id, list_filter(string_split(text, '.'), lambda p: p <> '') AS p FROM documents),
      r AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS i FROM parts),
      g AS (SELECT *, sum((length(t) > 30 OR i = 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
      m AS (SELECT doc_id, run, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM g GROUP BY ALL)
      SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY run)) AS digest FROM m GROUP BY doc_id""")
def merge_tiny_texts(t: Tables) -> DataFrame:
    parts = _docs(t).select("doc_id", F.array_remove(F.split("text", r"\."), "").alias("texts"))
    merged = ch.merge_tiny(parts, 30).filter(F.size("texts") > 0)
    return merged.select("doc_id", F.size("texts").alias("n"), F.md5(F.array_join("texts", "|")).alias("digest"))


@BOOK.add("chunk_recursive")
def chunk_recursive(t: Tables) -> DataFrame:
    return ch.chunk(decorated(t), "recursive").drop("text", "source")


@BOOK.add("chunk_heading_aware")
def chunk_heading_aware(t: Tables) -> DataFrame:
    return ch.chunk(decorated(t), "heading_aware").drop("text", "source")


# Headings line by line: the sample texts bring some of their own.
@BOOK.add("extract_headings", rf"""
      WITH {DECORATED},
      ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i, length(text) AS n FROM d),
      o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM ln),
      h AS (SELECT doc_id, n, start_offset,
              regexp_replace(regexp_extract(line || chr(10), '{ch.HEADING}', 0), '\s+$', '') AS title
            FROM o WHERE regexp_matches(line || chr(10), '{ch.HEADING}'))
      SELECT doc_id, row_number() OVER w - 1 AS heading_index, title, start_offset,
             CASE WHEN title LIKE '#%' THEN length(regexp_extract(title, '^#+', 0))
                  WHEN lower(title) LIKE 'chapter%' THEN 1
                  ELSE len(string_split(regexp_extract(title, '^\d+(\.\d+)*', 0), '.')) END AS level,
             coalesce(lead(start_offset) OVER w, n) AS end_offset
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY start_offset)""")
def extract_headings(t: Tables) -> DataFrame:
    return ch.extract_headings(decorated(t))


@BOOK.add("chunk_rejects", """
      SELECT doc_id, 'empty document' AS error FROM documents WHERE doc_id % 50 = 0 OR length(text) = 0""")
def chunk_rejects(t: Tables) -> DataFrame:
    return ch.chunk_rejects(t.text("documents").withColumn(
        "text", F.when(F.col("doc_id") % 50 == 0, "").otherwise(F.col("text"))))


# Sentences as chunks give every check something to find: they can be tiny,
# oversized or repeated; offsets and pages are disturbed by position.
_SENT = """
      parts AS (SELECT doc_id, string_split(text, '. ') AS p FROM documents),
      sent AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS chunk_index FROM parts),
      placed AS (SELECT doc_id, chunk_index, text,
          CASE WHEN chunk_index % 17 = 5 THEN -1 ELSE chunk_index * 100 END AS start_offset,
          CASE WHEN chunk_index % 13 = 4 THEN chunk_index * 100 - 50
               WHEN chunk_index % 11 = 3 THEN chunk_index * 100 + 150 ELSE chunk_index * 100 + 99 END AS end_offset,
          CASE WHEN chunk_index % 5 <> 2 THEN 1 END AS page_number FROM sent)"""


def _sentences(t: Tables) -> DataFrame:
    i = F.col("chunk_index")
    rows = t.text("documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("chunk_index", "text"))
    return rows.select(
        "doc_id", "chunk_index", "text",
        F.when(i % 17 == 5, -1).otherwise(i * 100).alias("start_offset"),
        F.when(i % 13 == 4, i * 100 - 50).when(i % 11 == 3, i * 100 + 150).otherwise(i * 100 + 99).alias("end_offset"),
        F.when(i % 5 != 2, 1).alias("page_number"))


_DUP = """
      dup AS (SELECT doc_id, chunk_index, min(chunk_index) OVER w AS duplicate_of,
                row_number() OVER (PARTITION BY doc_id, text ORDER BY chunk_index) - 1 AS earlier_copies,
                list(chunk_index) OVER (PARTITION BY doc_id, text ORDER BY chunk_index
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier
              FROM placed WINDOW w AS (PARTITION BY doc_id, text))"""


@BOOK.add("duplicate_chunks", f"""
      WITH {_SENT}, {_DUP}
      SELECT doc_id, chunk_index, duplicate_of, earlier_copies, array_to_string(earlier, ',') AS earlier
      FROM dup WHERE earlier_copies > 0""")
def duplicate_chunks(t: Tables) -> DataFrame:
    found = ql.duplicate_chunks(_sentences(t))
    return found.withColumn("earlier", F.concat_ws(",", F.transform("earlier", lambda i: i.cast("string"))))


_FINDINGS = rf"""
      {_SENT}, {_DUP},
      ahead AS (SELECT *, lead(chunk_index) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS nxt,
                  lag(end_offset) OVER (PARTITION BY doc_id ORDER BY start_offset, chunk_index) AS before FROM placed),
      findings AS (
        SELECT doc_id, chunk_index, 'empty' AS check_name, 'error' AS severity FROM ahead
          WHERE regexp_replace(text, '\s', '', 'g') = ''
        UNION ALL SELECT doc_id, chunk_index, 'oversized', 'warning' FROM ahead WHERE length(text) > 300
        UNION ALL SELECT doc_id, chunk_index, 'tiny', 'warning' FROM ahead WHERE length(text) < 20 AND nxt IS NOT NULL
        UNION ALL SELECT doc_id, chunk_index, 'page_number', 'warning' FROM ahead WHERE page_number IS NULL
        UNION ALL SELECT doc_id, chunk_index, 'negative_offset', 'error' FROM ahead
          WHERE start_offset < 0 OR end_offset < 0
        UNION ALL SELECT doc_id, chunk_index, 'inverted_offset', 'error' FROM ahead WHERE start_offset > end_offset
        UNION ALL SELECT doc_id, chunk_index, 'overlap', 'warning' FROM ahead WHERE start_offset < before
        UNION ALL SELECT doc_id, chunk_index, 'duplicate', 'warning' FROM dup WHERE earlier_copies > 0)"""


@BOOK.add("chunk_findings", f"WITH {_FINDINGS} SELECT * FROM findings")
def chunk_findings(t: Tables) -> DataFrame:
    return ql.chunk_findings(_sentences(t), min_size=20, max_size=300)


for _name, _strict in (("chunk_verdicts", False), ("chunk_verdicts_strict", True)):
    _error = "true" if _strict else "severity = 'error'"

    @BOOK.add(_name, f"""
      WITH {_FINDINGS},
      v AS (SELECT doc_id, count(*) FILTER ({_error}) AS errors, count(*) FILTER (NOT ({_error})) AS warnings,
              list_sort(list(DISTINCT check_name)) AS failed_checks FROM findings GROUP BY doc_id)
      SELECT doc_id, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors,
             coalesce(warnings, 0) AS warnings, coalesce(failed_checks, []) AS failed_checks
      FROM documents LEFT JOIN v USING (doc_id)""")
    def _verdicts(t: Tables, strict: bool = _strict) -> DataFrame:
        found = ql.chunk_findings(_sentences(t), min_size=20, max_size=300, strict=strict)
        return ql.verdicts(t.documents, found, "doc_id")
