"""Documents to chunks.

Every strategy works on one document row at a time with array functions, so
chunking needs no shuffle and no window: overlap, page numbers and merging are
done while the chunks of a document are still one array.

Input: doc_id, text [, pages array<string>]; other columns are inherited.
Output: chunk_id, chunk_index, text, start_offset, end_offset, token_count,
page_number, section, heading, strategy, and the inherited columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.functions.running import running_totals
from corpuskit.functions.settle import settle
from corpuskit.operators.ordered import with_neighbour

# --- fixed values -----------------------------------------------------------
SEPARATORS = ("\n\n", "\n", ".", " ", "")
CHUNK_SIZE, OVERLAP, MIN_SIZE, TINY = 1000, 200, 100, 30
# Headings of the heading-aware strategy: markdown, numbered, chapter.
HEADING = r"^(#{1,6}\s+|(?:\d+\.)+(?:\d+\s|\s)|(?:CHAPTER|Chapter|chapter)\s+\d+)"
# Headings of the recursive strategy also know lettered and section headings.
RECURSIVE_HEADING = (
    r"^(?:#{1,6}\s+|(?:[A-Z]\.\s*)+|"
    r"(?:CHAPTER|Chapter|chapter|SECTION|Section|section)\s+\d+[\.\s]|"
    r"\d+\.\d+\s+|^\d+\.\s+)"
)
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"
# How a heading starts, and its level: a number, and one more for each of a character in the match.  The first that fits.
HEADING_LEVELS = (
    (r"^#+(?=\s)", 0, "#"),
    (r"^(?i:chapter\s+\d+)", 1, ""),
    (r"^\d+(?:\.\d+)*", 1, "."),
    (r"^[A-Z]\s*\.\s", 1, ""),
)
OTHER_LEVEL = 2
# ----------------------------------------------------------------------------

# Multi-line with \n as the only line end, Unicode classes.
_FLAGS = "(?mdU)"

# ``page_at`` is the offset whose page the chunk is said to stand on.
CHUNK_TYPE = "struct<start_offset:int,end_offset:int,text:string,section:string,heading:string,page_at:int>"


def _chunk(start: Column, end: Column, text: Column, section: Column | None = None,
           heading: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), text.alias("text"),
        (none if section is None else section).alias("section"),
        (none if heading is None else heading).alias("heading"), start.cast("int").alias("page_at"))


def _nonblank(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: tx.strip(p) != "")


def _cut_before(text: Column, pattern: str) -> Column:
    """Pieces of a text, cut in front of every heading."""
    at_heading = pattern.replace("^", "^(?=", 1) + ")" if pattern.startswith("^") else f"(?={pattern})"
    return F.split(text, _FLAGS + at_heading)


# --- fixed-size windows -----------------------------------------------------


def _spans(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[tuple[int, int]]:
    """Windows of ``size``, each cut after the last occurrence of the first
    separator it contains; the next one starts ``overlap`` before the cut."""
    out, at, n = [], 0, len(text)
    while at < n:
        stop = min(at + size, n)
        if stop < n:
            for sep in separators:
                found = text.rfind(sep, at, stop) if sep else -1
                if found >= 0:
                    stop = found + len(sep)
                if found >= 0 or not sep:
                    break
        out.append((at, stop))
        at = stop - overlap if stop - overlap > at else stop
    return out


def fixed_chunks(
    df: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS
) -> DataFrame:
    """Only the cut positions come from Python; the JVM takes the texts."""

    @F.pandas_udf("array<struct<a:int,b:int>>")
    def cuts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [
            {"a": a, "b": b} for a, b in _spans(text or "", size, overlap, separators)])

    chunks = F.transform(cuts("text"), lambda c: _chunk(
        c["a"], c["b"], tx.strip(F.substring("text", c["a"] + 1, c["b"] - c["a"]))))
    return settle(df.withColumn("_c", F.filter(chunks, lambda c: c["text"] != "")), "_c")


# --- recursive splitting ----------------------------------------------------


def _heads(pieces: Column, starts_new: Callable[[Column], Column]) -> Column:
    """1-based places where a run starts: the first, and wherever ``starts_new`` holds."""
    marked = F.transform(pieces, lambda p, i: F.when((i == 0) | starts_new(p), i + 1))
    return F.array_compact(marked)


def _runs(pieces: Column, heads: Column) -> Column:
    """array<array<piece>>, cut at ``heads``."""
    return F.transform(heads, lambda h, j: F.slice(
        pieces, h, F.coalesce(F.get(heads, j + 1), F.size(pieces) + 1) - h))


# How a piece over the size is split, level by level.
LEVELS: tuple[Callable[[Column], Column], ...] = (
    lambda p: _cut_before(p, RECURSIVE_HEADING),
    lambda p: F.split(p, "\n\n"),
    lambda p: F.split(p, SENTENCE_GAP),
    lambda p: F.split(p, " "),
    lambda p: F.split(p, ""),
)


def _when_over(size: int, split: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Two or more pieces replace a segment over ``size``; otherwise it goes on unsplit."""
    def step(s: Column) -> Column:
        several = F.transform(
            F.array(_nonblank(split(s))), lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array(s)))
        return F.when(F.length(s) > size, F.get(several, F.lit(0))).otherwise(F.array(s))

    return step


def recursive_chunks(df: DataFrame, size: int = CHUNK_SIZE, min_size: int = MIN_SIZE) -> DataFrame:
    """Heading, paragraph, sentence, word, character: each level splits what is
    still over ``size``.  A segment under ``min_size`` is appended to the chunk
    before it with a newline, even past ``size``.  Offsets add up segment
    lengths, without the separators that splitting removed."""
    df = df.withColumn("_seg", F.array("text"))
    for split in LEVELS:
        pieces = F.transform("_seg", _when_over(size, split))
        df = df.withColumn("_seg", _nonblank(F.flatten(pieces)))
    df = df.withColumn("_heads", _heads(F.col("_seg"), lambda s: F.length(tx.strip(s)) >= min_size))
    df = df.withColumn("_runs", F.transform(_runs(F.col("_seg"), F.col("_heads")), lambda r: F.struct(
        F.aggregate(r, F.lit(0), lambda n, s: n + F.length(s)).alias("n"),
        F.array_join(F.transform(r, tx.strip), "\n").alias("t"))))
    df = df.withColumn("_ends", running_totals(F.transform("_runs", lambda r: r["n"])))
    return df.withColumn("_c", F.transform("_runs", lambda r, i: _chunk(
        F.get("_ends", i) - r["n"], F.get("_ends", i), r["t"]))).drop("_runs", "_ends")


# --- headings and sections --------------------------------------------------


def heading_level(prefix: Column) -> Column:
    """The level that ``HEADING_LEVELS`` gives the start of a heading."""
    out = F
    for pattern, level, counted in HEADING_LEVELS:
        found = F.regexp_extract(prefix, pattern, 0)
        times = F.length(found) - F.length(F.replace(found, F.lit(counted), F.lit(""))) if counted else F.lit(0)
        out = out.when(prefix.rlike(pattern), F.lit(level) + times)
    return out.otherwise(OTHER_LEVEL)


def with_sections(
    df: DataFrame, pattern: str = HEADING, heading_text: str = "prefix"
) -> DataFrame:
    """Add ``_sections``: struct(start, end, level, title) in order.

    Text before the first heading is a level-1 ``(preamble)``, a text without
    headings one ``(document)``.  ``heading_text``: title is the matched
    ``prefix`` or the whole heading ``line``.
    """
    df = df.withColumn("_cut", F.filter(_cut_before(F.col("text"), pattern), lambda p: p != ""))
    df = df.withColumn("_ends", running_totals(F.transform("_cut", F.length)))
    df = df.withColumn("_placed", F.transform("_cut", lambda p, i: F.struct(
        (F.get("_ends", i) - F.length(p)).alias("start"), F.get("_ends", i).alias("end"), p.alias("body")))).drop("_ends")
    df = df.withColumn("_marked", F.transform("_placed", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.regexp_extract(s["body"], "(?U)" + pattern, 0).alias("prefix"),
        F.regexp_extract(s["body"], r"^[^\n]*", 0).alias("line"))))
    bare = F.when(F.size("_cut") == 1, F.lit("(document)")).otherwise(F.lit("(preamble)"))
    shown = "line" if heading_text == "line" else "prefix"
    return df.withColumn("_sections", F.transform("_marked", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["prefix"] == "", F.lit(1)).otherwise(heading_level(s["prefix"])).alias("level"),
        F.when(s["prefix"] == "", bare).otherwise(tx.strip(s[shown])).alias("title"))))


def extract_headings(df: DataFrame, pattern: str = HEADING, heading_text: str = "prefix") -> DataFrame:
    """One row per heading: doc_id, heading_index, level, title, start_offset, end_offset."""
    real = F.filter("_sections", lambda s: ~s["title"].isin("(document)", "(preamble)"))
    return (
        with_sections(df.select("doc_id", "text"), pattern, heading_text)
        .select("doc_id", F.posexplode_outer(real).alias("heading_index", "_h"))
        .filter(F.col("heading_index").isNotNull())
        .select("doc_id", "heading_index", F.col("_h.level").alias("level"), F.col("_h.title").alias("title"),
                F.col("_h.start").alias("start_offset"), F.col("_h.end").alias("end_offset"))
    )


def _leaves(text: str, cut: re.Pattern, prefix: re.Pattern, line_titles: bool, keep_parent_text: bool):
    """(start, end, title, path) of the sections to chunk, in order."""
    starts = [m.start() for m in cut.finditer(text)]
    edges = [*([0] if not starts or starts[0] else []), *starts, len(text)]
    sections = []
    for start, end in zip(edges, edges[1:]):
        found = prefix.match(text, start)
        if start == end:
            continue
        if found is None:
            sections.append((start, end, 1, "(document)" if len(edges) == 2 else "(preamble)"))
        else:
            stop = text.find("\n", start)
            title = text[start:stop if stop >= 0 else None] if line_titles else found.group()
            sections.append((start, end, title_level(found.group()), title.strip()))
    stack: list[tuple[int, str]] = []
    for at, (start, end, level, title) in enumerate(sections):
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        if keep_parent_text or at + 1 == len(sections) or sections[at + 1][2] <= level:
            yield start, end, title, " > ".join(name for _, name in stack)


def title_level(prefix: str) -> int:
    """As ``heading_level``, for one text."""
    for pattern, level, counted in HEADING_LEVELS:
        if found := re.match(pattern, prefix):
            return level + (found.group().count(counted) if counted else 0)
    return OTHER_LEVEL


def _pieces(body: str, size: int) -> tuple[str, int, list[tuple[int, int]]]:
    """Glue, what it counts, and the places of what a body over ``size`` is packed
    from: its paragraphs if it has several, else its sentences, else plain slices."""
    def between(gaps) -> list[tuple[int, int]]:
        edges = [0]
        for gap in gaps:
            edges += [gap.start(), gap.end()]
        edges.append(len(body))
        return list(zip(edges[::2], edges[1::2]))

    paragraphs = [(a, b) for a, b in between(re.finditer("\n\n", body)) if body[a:b].strip()]
    if len(paragraphs) > 1:
        return "\n\n", 2, paragraphs
    sentences = between(_GAP.finditer(body))
    if len(sentences) > 1:
        return " ", 0, sentences
    return "", 0, [(a, min(a + size, len(body))) for a in range(0, len(body), size)]


def _packed(body: str, size: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, text) of the pieces joined until the next one would pass ``size``."""
    glue, extra, pieces = _pieces(body, size)
    held, group = 0, []
    for a, b in [*pieces, (0, 0)]:
        last = len(group) and (a, b) == (0, 0)
        if group and (last or held + b - a + extra > size):
            yield group[0][0], group[-1][1], glue.join(body[x:y] for x, y in group).strip()
            held, group = 0, []
        group.append((a, b))
        held += b - a + extra


_GAP = re.compile(r"(?<=[.!?])\s+")


def heading_aware_chunks(
    df: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, tiny: int = TINY,
    pattern: str = HEADING, heading_text: str = "prefix", keep_parent_text: bool = False,
) -> DataFrame:
    """Leaf sections, split where over ``size``; sections of at most ``tiny``
    characters join the chunk before them; each chunk then gains the first
    ``overlap`` characters of the next.

    A section followed by a deeper heading is no leaf and its own text is left
    out, unless ``keep_parent_text``.  Offsets are the places of the first and
    last piece, carried along from the split.  A chunk that took in a tiny
    section stands on the page of its new end.  One pass over the text.
    """
    bare = pattern.removeprefix("^")
    cut, prefix = re.compile(f"^(?={bare})", re.MULTILINE), re.compile(bare)

    def of(text: str | None) -> list[dict]:
        out: list[dict] = []
        for start, end, title, section in _leaves(
                text or "", cut, prefix, heading_text == "line", keep_parent_text):
            raw = text[start:end]
            body = raw.strip()
            base = start + len(raw) - len(raw.lstrip())
            if not body:
                continue
            if len(body) <= tiny and out:
                out[-1]["parts"].append(body)
                out[-1].update(end_offset=end, page_at=end)
                continue
            parts = [(start, end, body)]
            if len(body) > size:
                parts = [(base + a, base + b, t) for a, b, t in _packed(body, size)]
                if len(parts) == 1:
                    parts = [(start, end, parts[0][2])]
            out += [{"start_offset": a, "end_offset": b, "page_at": a, "parts": [t], "section": section,
                     "heading": title} for a, b, t in parts]
        for chunk_ in out:
            chunk_["text"] = "\n\n".join(chunk_.pop("parts"))
        return out

    @F.pandas_udf(f"array<{CHUNK_TYPE}>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    df = settle(df.withColumn("_merged", cut_up("text")), "_merged")
    return df.withColumn("_c", forward_overlap(F.col("_merged"), overlap))


def forward_overlap(chunks: Column, n: int = OVERLAP) -> Column:
    """Append the first ``n`` characters of the next chunk's own text."""
    if n <= 0:
        return chunks
    return F.transform(chunks, lambda c, i: F.when(
        F.length(F.get(chunks, i + 1)["text"]) > 0,
        c.withField("text", F.concat_ws(
            "\n\n", c["text"], F.substring(F.get(chunks, i + 1)["text"], 1, n)))).otherwise(c))


def merge_tiny(df: DataFrame, tiny: int = TINY) -> DataFrame:
    """On a column ``texts`` (array): texts of at most ``tiny`` characters join
    the one before them."""
    df = df.withColumn("_heads", _heads(F.col("texts"), lambda c: F.length(c) > tiny))
    df = df.withColumn("_runs", _runs(F.col("texts"), F.col("_heads")))
    return df.withColumn("texts", F.transform("_runs", lambda r: F.array_join(r, "\n\n"))).drop(
        "_heads", "_runs")


# --- pages and output -------------------------------------------------------


def page_ends(pages: Column) -> Column:
    """Running total of page lengths."""
    return running_totals(F.transform(pages, F.length))


def page_of(offset: Column, ends: Column) -> Column:
    """First page whose running length passes the offset; past the end the last
    page; null without pages.  Pages count from 1."""
    return F.when(
        F.size(ends) > 0, F.least(F.size(F.filter(ends, lambda e: e <= offset)) + 1, F.size(ends)))


def chunk(
    df: DataFrame, strategy: str = "heading_aware", max_chunks: int = 0, **options
) -> DataFrame:
    """Chunk every non-empty document with one of the three strategies.

    An empty document gives no chunks.
    """
    builders = {"fixed": fixed_chunks, "recursive": recursive_chunks, "heading_aware": heading_aware_chunks}
    inherited = [c for c in df.columns if c not in ("text", "pages")]
    pages = F.col("pages") if "pages" in df.columns else F.array().cast("array<string>")
    built = builders[strategy](settle(df, "text"), **options)
    listed = built.select(*inherited, "_c", page_ends(pages).alias("_p"))
    if max_chunks > 0:
        listed = listed.withColumn("_c", F.slice("_c", 1, max_chunks))
    # The outer form with a filter behind it: the inner form would have Catalyst
    # push "array not empty" below all stages and chunk every document twice.
    rows = listed.select(
        *inherited, "_p", F.posexplode_outer("_c").alias("chunk_index", "_k")
    ).filter(F.col("chunk_index").isNotNull())
    return rows.select(
        F.concat_ws("#", "doc_id", "chunk_index").alias("chunk_id"), *inherited, "chunk_index",
        F.col("_k.text").alias("text"), F.col("_k.start_offset").alias("start_offset"),
        F.col("_k.end_offset").alias("end_offset"),
        tx.tokens_estimate(F.col("_k.text")).alias("token_count"),
        page_of(F.col("_k.page_at"), F.col("_p")).alias("page_number"),
        F.col("_k.section").alias("section"), F.col("_k.heading").alias("heading"),
        F.lit(strategy).alias("strategy"))


def chunk_rejects(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.length("text"), F.lit(0)) == 0).select(
        "doc_id", F.lit("empty document").alias("error"))


def inherit_metadata(chunks: DataFrame, documents: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Copy document fields onto chunk rows that come from elsewhere."""
    return chunks.join(documents.select("doc_id", *fields), "doc_id", "left")


def overlap_rows(chunks: DataFrame, n: int = OVERLAP) -> DataFrame:
    """``forward_overlap`` for a chunk table: doc_id, chunk_index, text."""
    ahead = with_neighbour(chunks, ["doc_id"], "chunk_index", ["text"], "_next")
    longer = F.concat_ws("\n\n", "text", F.substring("_next.text", 1, n))
    return ahead.withColumn(
        "text", F.when(F.length("_next.text") > 0, longer).otherwise(F.col("text"))
    ).withColumn("token_count", tx.tokens_estimate(F.col("text"))).drop("_next")


def chunk_statistics(chunks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    size = F.length("text")
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("number_of_chunks"),
        F.avg(size).alias("average_chunk_size"),
        F.max(size).alias("largest_chunk"),
        F.min(size).alias("smallest_chunk"),
        F.avg("token_count").alias("average_tokens"),
        F.stddev_samp(size).alias("size_stddev"),
    )
