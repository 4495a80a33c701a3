"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.llm.divergence import source_divergence
from corpuskit.llm.fingerprints import document_fingerprints
from corpuskit.llm.license_scan import NOTICES, PHRASES, license_scan
from corpuskit.llm.line_dedup import line_dedup
from corpuskit.llm.mixing import mix
from corpuskit.llm.order_minhash import near_duplicates
from corpuskit.llm.packing import best_fit_packing
from corpuskit.llm.quality_rules import quality_rules
from corpuskit.llm.secret_scan import BASE, secret_scan
from corpuskit.llm.sharding import shard_places
from corpuskit.llm.token_alignment import token_alignment
from corpuskit.llm.token_counts import token_counts
from corpuskit.llm.toxicity import toxicity
from corpuskit.workload.common import Book

BOOK = Book()


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

QUALITY_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM worded)),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM grams, (SELECT unnest(range(0, 3)) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)),
judged AS (
  SELECT doc_id, line, len(w) > 0 AS worded, len(w) > 0 AND (
    (length(line) - length(translate(line, '#*$%&|<>', ''))) * 4 > len(w)
    OR (length(line) - length(regexp_replace(line, '[!?]{2}', 'x', 'g'))) * 5 > len(w)
    OR len(list_filter(range(1, greatest(len(w) - 4, 1)), lambda i: w[i] = w[i+1] AND w[i] = w[i+2]
         AND w[i] = w[i+3] AND w[i] = w[i+4] AND w[i] = w[i+5])) > 0
    OR (len(w) >= 60 AND NOT regexp_matches(line, '[.,;:!?…。，]'))
    OR (len(w) <= 15 AND regexp_matches(lower(line), 'all rights reserved|click here|cookie|enable javascript|follow us|lorem ipsum|privacy policy|read more|share this|sign in|sign up|subscribe|terms of service|terms of use'))
  ) AS fails FROM lines),
by_doc AS (
  SELECT doc_id,
    count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines,
    coalesce(coalesce(sum(length(line)) FILTER (fails), 0) / nullif(sum(length(line)) FILTER (worded), 0), 0.0) AS lost_share
  FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, lost_share
  FROM worded JOIN by_doc USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(lost_share, 6) AS lost_share,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.3 AS kept
FROM base
"""


@BOOK.add("op1_quality_rules", QUALITY_SQL)
def _(t):
    judged = quality_rules(t.documents.select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_share")


def _of(*kinds: str):
    return F.filter("secrets", lambda x: x["kind"].isin(*kinds))


def _digest(kinds: tuple[str, ...] | None):
    spans = F.col("secrets") if kinds is None else _of(*kinds)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


@BOOK.add("op6_secret_scan")
def _(t):
    kinds = tuple(kind for kind, *_ in BASE)
    return secret_scan(t.documents).select(
        "doc_id",
        *[F.size(_of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_digest(kinds), 256).alias("base_sha256"), _digest(None).alias("spans"),
        "n_live", "n_shared", "n_example",
        *[F.array_join(F.transform("uses", lambda u: u[c].cast("string")), ",").alias(c)  # noqa: B023
          for c in ("owners", "repositories")])


@BOOK.add("op4_best_fit_packing", as_is=("piece",))
def _(t):
    return best_fit_packing(t.documents, tokenizer_file("word_bpe_49k.json"))


@BOOK.add("op8_token_counts")
def _(t):
    return token_counts(t.documents.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json")).drop("text")


MIX_SQL = """
WITH sizes AS (
  SELECT coalesce(source, '') AS source, sum(greatest(length(coalesce(text, '')), 1))::DOUBLE AS size
  FROM documents GROUP BY 1),
rates AS (
  SELECT source, sqrt(size) * ((SELECT sum(size) FROM sizes) / (SELECT sum(sqrt(size)) FROM sizes)) / size AS rate
  FROM sizes),
steps AS (
  SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates),
logs AS (
  SELECT source, k, -rate + k * ln(rate) - sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END)
    OVER (PARTITION BY source ORDER BY k) AS log FROM steps),
cdf AS (SELECT source, k, sum(exp(log)) OVER (PARTITION BY source ORDER BY k) AS p FROM logs),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0) AS u
  FROM documents d),
counted AS (
  SELECT d.doc_id, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.source) AS source,
    any_value(d.n_chars) AS n_chars, count(*) AS copies
  FROM drawn d JOIN cdf c ON coalesce(d.source, '') = c.source AND c.p <= d.u GROUP BY d.doc_id)
SELECT doc_id, text, lang, source, n_chars, copy, copies,
  ('0x' || substr(md5('mix:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 13))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted)
"""


@BOOK.add("op9_poisson_mixing", MIX_SQL)
def _(t):
    return mix(t.documents)


@BOOK.add("op3_document_fingerprints", as_is=("near_edited", "near_next"))
def _(t):
    return document_fingerprints(t.documents)


@BOOK.add("op10_toxicity", as_is=("predicted",))
def _(t):
    scored = toxicity(t.documents.select("doc_id", "text"), t.labels).drop("text")
    # Rounding must not carry a score over the threshold.
    return scored.withColumn("score", F.floor(F.col("score") * 1e6) / 1e6)


def _license_sql() -> str:
    rows = ",\n".join(
        f"('{label}/{i}', '{label}', {base}, '{text}')"
        for base, group in (("true", PHRASES), ("false", NOTICES)) for i, (label, text) in enumerate(group))
    return rf"""
WITH templates(template, label, base, text) AS (VALUES {rows}),
template_words AS (
  SELECT *, string_split(text, ' ') AS w, CASE WHEN len(string_split(text, ' ')) <= 6 THEN 2 ELSE 3 END AS k
  FROM templates),
grams AS (
  SELECT template, label, base, k, len(w) - k + 1 AS grams, place - 1 AS place, w[place:place + k - 1] AS gram
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS place FROM template_words)),
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rolled AS (
  SELECT doc_id, k, p - 1 AS position, w[p:p + k - 1] AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS p
        FROM worded, (SELECT unnest([2, 3]) AS k))),
hits AS (
  SELECT doc_id, template, label, base, grams, place, position, position - place AS diagonal
  FROM rolled r JOIN grams g ON r.k = g.k AND r.gram = g.gram),
marked AS (
  SELECT doc_id, template, diagonal, coalesce(diagonal - lag(diagonal) OVER (
    PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN any_value(base) THEN 0 ELSE 2 END, true)::INT AS apart
  FROM hits GROUP BY doc_id, template, diagonal),
islands AS (
  SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM marked),
-- Through a span in order: places behind all places before them.
ordered AS (
  SELECT *, place > coalesce(max(place) OVER (PARTITION BY doc_id, template, island ORDER BY position, place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS follows
  FROM hits JOIN islands USING (doc_id, template, diagonal)),
placed AS (
  SELECT doc_id, template, label, base, count(*) FILTER (follows) / any_value(grams) AS coverage, min(position) AS start
  FROM ordered GROUP BY doc_id, template, label, base, island),
scored AS (
  SELECT doc_id, count(*) FILTER (base AND coverage = 1) AS n_base,
    min(start) FILTER (base AND coverage = 1) AS first_word, max(start) FILTER (base AND coverage = 1) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND coverage = 1) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN base THEN coverage = 1 ELSE coverage >= 0.8 END)
      AS labels,
    max(coverage) FILTER (NOT base OR coverage = 1) AS score
  FROM placed GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM worded LEFT JOIN scored USING (doc_id)
"""


@BOOK.add("op5_license_scan", _license_sql())
def _(t):
    return license_scan(t.documents).drop("spans")


@BOOK.add("op7_order_minhash")
def _(t):
    return near_duplicates(t.documents)


@BOOK.add("op2_line_dedup")
def _(t):
    cleaned = line_dedup(t.documents.select("doc_id", "text"), radius=None)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias(
        "text_sha256"))


@BOOK.add("op11_sampled_sharding", as_is=("shard", "grown_shard"))
def _(t):
    return shard_places(t.documents).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@BOOK.add("op13_token_alignment")
def _(t):
    return token_alignment(t.documents, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT row) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
parts AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)::HUGEINT) // (total + 5 * v) AS p,
    1 + (1000000000 * (lang_n + 5)::HUGEINT) // (lang_total + 5 * v) AS q FROM shares),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (
      SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
      FROM parts x JOIN parts y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
    ON a.lang = d.lang AND a.source = d.source AND b.source = d.item)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', term, (p - q)::BIGINT,
  (row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term))::INT AS rank
FROM parts WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= 50
"""


@BOOK.add("op12_source_divergence", DIVERGENCE_SQL, as_is=("rank",))
def _(t):
    return source_divergence(t.documents)
