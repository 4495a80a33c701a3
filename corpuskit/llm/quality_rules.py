"""Line-first quality rules: drop failing lines, then documents that lose too much.

Native functions only.  A document is one row in one task throughout: nothing is
shuffled, so neither a hot source nor a group of copies matters.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.settle import settle
from corpuskit.llm.rows import packed, unpacked, whole_text

# What counts as a word, a symbol, and the base thresholds.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
WINDOW = 3
RUN = 6
SPACE = " \t\n\x0b\x0c\r"

# Phrases of page furniture, looked for in short lines only.
FURNITURE = (
    "all rights reserved", "click here", "cookie", "enable javascript", "follow us", "lorem ipsum",
    "privacy policy", "read more", "share this", "sign in", "sign up", "subscribe", "terms of service",
    "terms of use",
)
SHORT_LINE_WORDS = 15


def _count(line: Column, characters: str) -> Column:
    return F.char_length(line) - F.char_length(F.translate(line, characters, ""))


def line_fails(line: Column, words: Column, symbols: Column, shouts: Column, runs: Column) -> Column:
    """True where any rule rejects the line of so many words.

    * navigation and symbols: more than one symbol for every four words;
    * shouting: more than one doubled exclamation or question mark for every five words;
    * repetition: one word six times in a row;
    * punctuation: sixty words or more without a single mark of punctuation;
    * boilerplate: a phrase of page furniture in a line of up to fifteen words.

    ``symbols``, ``shouts`` and ``runs`` say whether the document has any symbol,
    doubled mark or run of a word; where not, those rules need no look at the line.
    """
    doubled = F.char_length(line) - F.char_length(F.regexp_replace(line, r"[!?]{2}", "x"))
    return (
        (symbols & (_count(line, SYMBOLS) * 4 > words))
        | (shouts & (doubled * 5 > words))
        | (runs & line.rlike(
            r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1){5}(?![^\x20\x09-\x0D])"))
        | ((words >= 60) & ~line.rlike(r"[.,;:!?…。，]"))
        | ((words <= SHORT_LINE_WORDS) & F.lower(line).rlike("|".join(FURNITURE)))
    )


def quality_rules(docs: DataFrame, text: str = "text", max_lost: float = 0.3) -> DataFrame:
    """Add the base counts, ``clean_text``, ``lost_share``, ``base_failed`` and ``kept``.

    ``kept`` is false where the base rules fail or the failing lines hold more
    than ``max_lost`` of the characters of all lines.  Null and empty texts have
    no words and fail the base rules.  Lines without a word are neither judged
    nor counted as lost.  Equal rows get equal results; other columns pass.
    """
    df = packed(docs, _text=whole_text(text))
    df = settle(df.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))), "_words")
    n = F.size("_words")
    df = df.withColumn("n_words", n.cast("long"))
    # Windows as (hash, position), sorted: a repeated one has an equal neighbour.
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]).alias("h"), i.alias("i"))))
    runs = F.exists(
        F.when(n >= RUN, F.sequence(F.lit(0), n - RUN)),
        lambda i: reduce(and_, [F.get("_words", i) == F.get("_words", i + k) for k in range(1, RUN)]))
    df = df.withColumns({
        "word_chars": F.char_length(F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": _count(F.col("_text"), SYMBOLS).cast("long"),
        "_shouts": F.col("_text").rlike(r"[!?]{2}"), "_runs": F.coalesce(runs, F.lit(False)),
        "_sorted": F.sort_array(windows)}).drop("_words")
    df = settle(df, "_sorted", "n_symbols", "_shouts", "_runs")
    repeated = F.filter(
        "_sorted", lambda x, i: (x["h"] == F.get("_sorted", i - 1)["h"]) | (x["h"] == F.get("_sorted", i + 1)["h"]))
    df = settle(df.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_sorted"), "_at")
    covered = F.aggregate(
        F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")

    df = settle(df.withColumn("_lines", F.transform(F.split("_text", "\n"), lambda line: F.struct(
        line.alias("line"),
        F.size(F.split(F.trim(line, F.lit(SPACE)), r"[\x20\x09-\x0D]+")).alias("words"),
        line.rlike(r"[^\x20\x09-\x0D]").alias("worded")))), "_lines")
    judged = F.transform("_lines", lambda x: F.struct(
        x["line"].alias("line"), x["worded"].alias("worded"),
        (x["worded"] & line_fails(
            x["line"], x["words"], F.col("n_symbols") > 0, F.col("_shouts"), F.col("_runs"))).alias("fails")))
    df = settle(df.withColumn("_lines", judged), "_lines")
    with_word = F.transform(F.filter("_lines", lambda x: x["worded"]), lambda x: x["line"])

    def chars(test) -> Column:
        return F.aggregate(
            F.filter("_lines", test), F.lit(0).cast("long"), lambda acc, x: acc + F.char_length(x["line"]))

    df = settle(df.withColumns({
        "n_dup_lines": (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long"),
        "_all": chars(lambda x: x["worded"]), "_lost": chars(lambda x: x["fails"]),
        "clean_text": F.array_join(F.transform(
            F.filter("_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
    }).drop("_lines"), "_all", "_lost")
    base_failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.coalesce(F.col("_lost") / F.nullif("_all", F.lit(0)), F.lit(0.0))
    df = df.withColumns({"lost_share": lost, "base_failed": base_failed})
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))
    return unpacked(
        df, docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_share",
        "clean_text", "base_failed", "kept")
