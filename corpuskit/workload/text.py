"""Cleaning, metadata and sources over documents, pages and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators import cleaning, profiling
from corpuskit.sources import files
from corpuskit.workload.common import Book, Tables

BOOK = Book()

NL = "\n"


# Every document in full, with headings, page marks and odd characters around
# its three thirds: the raw table has none of them.
def decorated(t: Tables) -> DataFrame:
    docs = t.text("documents")
    third = F.floor(F.length("text") / 3).cast("int")
    lit = F.lit
    return docs.select("doc_id", "source", F.concat(
        lit("1. Intro\n\n"), F.substring("text", lit(1), third),
        lit("\nPage "), (F.col("doc_id") % 7).cast("string"), lit(" of 9\n\n1.1 Detail\n\n"),
        F.substring("text", third + 1, third),
        lit("\n- "), F.col("doc_id").cast("string"),
        lit(" -\n\n12\n13\n\n2. End  with   gaps\n\n\n\n“"),
        F.substring("text", 2 * third + 1, F.length("text")), lit("”​ – done…\n"),
    ).alias("text"))


DECORATED = """
      d AS (SELECT doc_id, source,
        '1. Intro' || chr(10) || chr(10) || substr(text, 1, (length(text) // 3)::INT)
        || chr(10) || 'Page ' || (doc_id % 7) || ' of 9' || chr(10) || chr(10) || '1.1 Detail' || chr(10) || chr(10)
        || substr(text, (length(text) // 3)::INT + 1, (length(text) // 3)::INT)
        || chr(10) || '- ' || doc_id || ' -' || chr(10) || chr(10) || '12' || chr(10) || '13' || chr(10) || chr(10)
        || '2. End  with   gaps' || chr(10) || chr(10) || chr(10) || chr(10) || chr(8220)
        || substr(text, 2 * (length(text) // 3)::INT + 1)
        || chr(8221) || chr(8203) || ' ' || chr(8211) || ' done' || chr(8230) || chr(10) AS text
        FROM documents)"""

_OUT = "SELECT doc_id, md5(out) AS digest, length(out) AS chars FROM o"


def digest(df: DataFrame, out: Column) -> DataFrame:
    return df.select("doc_id", out.alias("_o")).select(
        "doc_id", F.md5("_o").alias("digest"), F.length("_o").alias("chars"))


_NUM = r"^\s*[-–—]?\s*\d+\s*[-–—]?\s*$"
_MARK = r"(?i)^page\s+\d+(\s+of\s+\d+)?\s*$"
_LINES = "string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"

_WHITE = rf"""
      w AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, ' {{2,}}', ' ', 'g'), chr(10)),
              lambda l: {_STRIP.format('l')}) AS rows FROM d),
      o AS (SELECT doc_id, {_STRIP.format("regexp_replace(array_to_string(rows, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}
              AS out FROM w)"""


@BOOK.add("clean_whitespace", f"WITH {DECORATED}, {_WHITE} {_OUT}")
def clean_whitespace(t: Tables) -> DataFrame:
    return digest(decorated(t), tx.clean_whitespace(F.col("text")))


_TYPO = "text"
for _old, _new in tx.TYPOGRAPHIC.items():
    _TYPO = f"replace({_TYPO}, chr({ord(_old)}), '{_new.replace(chr(39), chr(39) * 2)}')"


@BOOK.add("replace_typographic", f"WITH {DECORATED}, o AS (SELECT doc_id, {_TYPO} AS out FROM d) {_OUT}")
def replace_typographic(t: Tables) -> DataFrame:
    return digest(decorated(t), tx.replace_typographic(F.col("text")))


@BOOK.add("strip_invisible", f"""WITH {DECORATED},
      o AS (SELECT doc_id, regexp_replace(text, '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}]', '', 'g')
              AS out FROM d) {_OUT}""")
def strip_invisible(t: Tables) -> DataFrame:
    return digest(decorated(t), tx.strip_invisible(F.col("text")))


@BOOK.add("nfkc")
def nfkc(t: Tables) -> DataFrame:
    return digest(decorated(t), tx.nfkc(F.col("text")))


_KEEP_NUM = f"""
      l AS (SELECT doc_id, {_LINES} AS rows FROM d),
      o AS (SELECT doc_id, array_to_string(list_filter(rows, lambda r, i:
              NOT regexp_matches(r, '{_NUM}')
              OR (i > 1 AND regexp_matches(rows[i - 1], '{_NUM}'))
              OR coalesce(regexp_matches(rows[i + 1], '{_NUM}'), false)), chr(10)) AS out FROM l)"""


@BOOK.add("drop_page_numbers", f"WITH {DECORATED}, {_KEEP_NUM} {_OUT}")
def drop_page_numbers(t: Tables) -> DataFrame:
    return digest(cleaning.drop_page_lines(decorated(t), markers=False), F.col("text"))


@BOOK.add("drop_page_markers", f"""WITH {DECORATED},
      l AS (SELECT doc_id, {_LINES} AS rows FROM d),
      o AS (SELECT doc_id, array_to_string(list_filter(rows, lambda r:
              NOT regexp_matches({_STRIP.format('r')}, '{_MARK}')), chr(10)) AS out FROM l) {_OUT}""")
def drop_page_markers(t: Tables) -> DataFrame:
    return digest(cleaning.drop_page_lines(decorated(t), numbers=False), F.col("text"))


@BOOK.add("collapse_blank_lines", rf"""WITH {DECORATED},
      o AS (SELECT doc_id, {_STRIP.format("regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN trim(l, ' ' || chr(9)) = '' THEN '' ELSE l END), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")}
              AS out FROM d) {_OUT}""")
def collapse_blank_lines(t: Tables) -> DataFrame:
    return digest(decorated(t), tx.collapse_blank_lines(F.col("text")))


# Three pages per document, each opening with the same line and closing with
# another; a page holds a third of the text.
def paged(t: Tables) -> DataFrame:
    third = F.floor(F.length("text") / 3).cast("int")
    head, foot = F.concat(F.lit("Report "), "source", F.lit("\n")), F.lit("\n - confidential -")
    parts = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, third),
             F.substring("text", 2 * third + 1, F.length("text"))]
    return t.text("documents").select("doc_id", F.concat_ws(
        "\f", *[F.concat(head, p, foot) for p in parts]).alias("text"))


PAGED = """
      parts AS (SELECT doc_id, unnest([substr(text, 1, (length(text) // 3)::INT),
            substr(text, (length(text) // 3)::INT + 1, (length(text) // 3)::INT),
            substr(text, 2 * (length(text) // 3)::INT + 1)]) AS part, unnest([1, 2, 3]) AS page, source
          FROM documents),
      pg AS (SELECT doc_id, page, 'Report ' || source || chr(10) || part || chr(10) || ' - confidential -' AS body
          FROM parts)"""


@BOOK.add("repeated_headers", rf"""WITH {PAGED},
      b AS (SELECT doc_id, page, body,
              string_split(body, chr(10)) AS rows FROM pg),
      v AS (SELECT *, length(body) >= 80 AND len(rows) > 2 AS votes FROM b),
      h AS (SELECT doc_id, line FROM (SELECT doc_id, {_STRIP.format('rows[1]')} AS line FROM v WHERE votes)
            WHERE line <> '' GROUP BY doc_id, line HAVING count(*) >= 2),
      f AS (SELECT doc_id, line FROM (SELECT doc_id, {_STRIP.format('rows[len(rows)]')} AS line FROM v WHERE votes)
            WHERE line <> '' GROUP BY doc_id, line HAVING count(*) >= 2),
      hs AS (SELECT doc_id, list(line) AS hl FROM h GROUP BY doc_id),
      fs AS (SELECT doc_id, list(line) AS fl FROM f GROUP BY doc_id),
      j AS (SELECT v.*, coalesce(hl, []) AS hl, coalesce(fl, []) AS fl
            FROM v LEFT JOIN hs USING (doc_id) LEFT JOIN fs USING (doc_id)),
      x AS (SELECT doc_id, page, body, rows, votes, hl, fl,
              list_min(list_filter(range(1, len(rows) + 1), lambda i: NOT list_contains(hl, {_STRIP.format('rows[i]')}))) AS a,
              list_max(list_filter(range(1, len(rows) + 1), lambda i: NOT list_contains(fl, {_STRIP.format('rows[i]')}))) AS z
            FROM j),
      y AS (SELECT doc_id, page, len(hl) + len(fl) > 0 AS fires, body,
              CASE WHEN NOT votes THEN array_to_string(rows, chr(10))
                   WHEN a IS NULL OR z IS NULL OR a > z THEN NULL
                   ELSE array_to_string(rows[a:z], chr(10)) END AS kept FROM x),
      o AS (SELECT doc_id, CASE WHEN bool_or(fires) THEN string_agg(kept, chr(10) || chr(10) ORDER BY page)
              ELSE string_agg(body, chr(12) ORDER BY page) END AS out FROM y GROUP BY doc_id)
      {_OUT}""")
def repeated_headers(t: Tables) -> DataFrame:
    return digest(cleaning.drop_repeated_headers_footers(paged(t)), F.col("text"))


@BOOK.add("clean_default_order")
def clean_default_order(t: Tables) -> DataFrame:
    return digest(cleaning.clean(decorated(t)), F.col("clean_text"))


# --- profiling --------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@BOOK.add("word_counts", f"""
      SELECT doc_id, length(text) AS char_count, len({_WORDS.format('text')}) AS word_count FROM documents""")
def word_counts(t: Tables) -> DataFrame:
    return profiling.text_counts(t.text("documents")).select("doc_id", "char_count", "word_count")


_EN = ", ".join(f"'{w}'" for w in tx.ENGLISH_WORDS)


@BOOK.add("detect_language", f"""
      WITH s AS (SELECT doc_id, lang, {_WORDS.format(f'lower(left(text, {tx.LANGUAGE_SAMPLE}))')} AS w FROM documents)
      SELECT doc_id, CASE WHEN len(list_filter(w, lambda x: list_contains([{_EN}], x))) / len(w)
             > {tx.ENGLISH_SHARE} THEN 'en' END AS language FROM s""")
def detect_language(t: Tables) -> DataFrame:
    return t.text("documents").select("doc_id", tx.detect_language_en(F.col("text")).alias("language"))


_NAME = "regexp_extract({0}, '([^/]*)/*$', 1)"
_STEM = r"regexp_replace({0}, '(.)\.[^.]*$', '\1')"


@BOOK.add("title_from_path", f"""
      WITH n AS (SELECT page_id, {_NAME.format("url")} AS name FROM pages)
      SELECT page_id, coalesce(nullif(trim(replace(replace({_STEM.format('name')}, '_', ' '), '-', ' ')), ''), name)
             AS title FROM n""")
def title_from_path(t: Tables) -> DataFrame:
    return t.text("pages").select("page_id", tx.title_from_path(F.col("url")).alias("title"))


_PARSED = """
      p AS (SELECT page_id, url, html,
              CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Title ' || page_id END AS title,
              CASE WHEN page_id % 2 = 0 THEN 'red; blue ,, green' END AS keywords FROM pages)"""


@BOOK.add("merge_metadata", f"""
      WITH {_PARSED}, n AS (SELECT *, {_NAME.format('url')} AS name FROM p),
      g AS (SELECT *, {_WORDS.format('lower(left(html, 2000))')} AS w, {_WORDS.format('html')} AS hw FROM n)
      SELECT page_id, coalesce(nullif(title, ''),
               coalesce(nullif(trim(replace(replace({_STEM.format('name')}, '_', ' '), '-', ' ')), ''), name)) AS title,
             CASE WHEN keywords IS NULL THEN 0 ELSE 3 END::BIGINT AS n_keywords,
             CASE WHEN len(list_filter(w, lambda x: list_contains([{_EN}], x))) / len(w) > {tx.ENGLISH_SHARE}
               THEN 'en' END AS language, length(html) AS char_count, len(hw) AS word_count,
             'k' || page_id AS kept FROM g""")
def merge_metadata(t: Tables) -> DataFrame:
    parsed = t.text("pages").select("page_id", F.col("url").alias("path"), F.col("html").alias("text"), F.create_map(
        F.lit("title"), F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("Title "), "page_id")),
        F.lit("keywords"), F.when(F.col("page_id") % 2 == 0, "red; blue ,, green"),
        F.lit("own"), F.concat(F.lit("k"), "page_id")).alias("parsed"))
    merged = profiling.merge_metadata(profiling.derive_metadata(parsed))
    return merged.select(
        "page_id", "metadata.title", F.size("metadata.keywords").alias("n_keywords"), "metadata.language",
        "metadata.char_count", "metadata.word_count", F.col("metadata.extra")["own"].alias("kept"))


@BOOK.add("processing_stats", f"""
      WITH {DECORATED}, {_WHITE}
      SELECT source, count(*) AS documents, sum(length(d.text))::BIGINT AS raw_chars,
             sum(length(o.out))::BIGINT AS clean_chars, count(*) AS pages
      FROM d JOIN o USING (doc_id) GROUP BY source""")
def processing_stats(t: Tables) -> DataFrame:
    cleaned = cleaning.clean(decorated(t), ["whitespace"])
    stats = profiling.processing_stats(cleaned, "text", "clean_text", F.size(F.split("text", "\f")))
    return profiling.processing_rollup(stats, ["source"])


# --- sources ----------------------------------------------------------------


@BOOK.add("documents_to_pages", rf"""
      WITH {PAGED}
      SELECT doc_id, page::BIGINT AS page_number, md5(body) AS digest, length(body) AS char_count,
             len({_WORDS.format('body')}) AS word_count FROM pg""")
def documents_to_pages(t: Tables) -> DataFrame:
    pages = files.documents_to_pages(paged(t))
    return pages.select("doc_id", "page_number", F.md5("content").alias("digest"), "char_count", "word_count")


@BOOK.add("admit_documents", """
      WITH n AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.TXT'
                   WHEN 2 THEN 'c.exe' ELSE 'noext' END AS name FROM documents)
      SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN 'invalid_file_extension'
             WHEN octet_length(encode(text)) > 4000 THEN 'file_too_large'
             WHEN length(text) > 3000 THEN 'expanded_text_too_large' END AS reject_reason FROM n""")
def admit_documents(t: Tables) -> DataFrame:
    kind = F.col("doc_id") % 4
    named = t.text("documents").select(
        "doc_id", "text", F.octet_length("text").alias("size"),
        F.when(kind == 0, "a.pdf").when(kind == 1, "b.TXT").when(kind == 2, "c.exe").otherwise("noext").alias("name"))
    good, bad = files.admit_documents(named, max_bytes=4000, max_chars=3000)
    return good.select("doc_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("doc_id", "reject_reason"))


@BOOK.add("checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksum(t: Tables) -> DataFrame:
    return files.with_checksum(t.text("documents")).select("doc_id", "checksum")


@BOOK.add("parse_keywords", """
      SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(
               p_name || ' ; ' || p_brand || ', ,' || p_type, '[,;]'), lambda x: trim(x)), lambda x: x <> '')
             AS keywords FROM part""")
def parse_keywords(t: Tables) -> DataFrame:
    raw = F.concat("p_name", F.lit(" ; "), "p_brand", F.lit(", ,"), "p_type")
    return t.part.select("p_partkey", tx.parse_keywords(raw).alias("keywords"))


@BOOK.add("parse_pdf_date", """
      SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def parse_pdf_date(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("+00'00'"))
    return t.orders.select(
        "o_orderkey", tx.parse_pdf_date(F.when(F.col("o_orderkey") % 10 == 0, "D:20x4").otherwise(raw)).alias("parsed"))


@BOOK.add("parse_iso_or_epoch", """
      SELECT event_id, CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts)
        WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN make_timestamp(2024 * 1000000)
        WHEN 3 THEN make_timestamp(86400 * 1000000::BIGINT) WHEN 4 THEN date_trunc('day', ts)
        WHEN 5 THEN make_timestamp(event_id * 500000) END AS parsed FROM events""")
def parse_iso_or_epoch(t: Tables) -> DataFrame:
    second, kind = F.date_trunc("second", F.col("ts").cast("timestamp")), F.col("event_id") % 8
    raw = (
        F.when(kind == 0, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 1, F.unix_timestamp(second).cast("string")).when(kind == 2, "2024").when(kind == 3, "86400")
        .when(kind == 4, F.date_format(second, "yyyy-MM-dd"))
        .when(kind == 5, (F.col("event_id") * 0.5).cast("decimal(20,1)").cast("string"))
        .when(kind == 6, "10:30:00").otherwise("not a date"))
    return t.events.select("event_id", tx.parse_iso_or_epoch(raw).alias("parsed"))


@BOOK.add("read_text_documents", """
      SELECT 'doc_' || doc_id AS title, '.txt' AS extension, length(text) AS char_count,
             len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END,
               chr(10))) AS line_count, sha256(text) AS checksum FROM documents""")
def read_text_documents(t: Tables) -> DataFrame:
    named = t.text("documents").select(
        F.concat(F.lit("/in/doc_"), "doc_id", F.lit(".txt")).alias("path"), "text")
    return files.with_checksum(files.text_documents(named)).select(
        "title", "extension", "char_count", "line_count", "checksum")
