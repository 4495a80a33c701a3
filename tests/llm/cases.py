"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, n_words string, uid int"

PROSE = "The quick brown fox jumps over the lazy dog, and then it rests a while. "
CLEAN = ". ".join(" ".join(f"plain{i}{j}" for j in range(9)) for i in range(8)) + "."
LONG = " ".join(f"word{i % 5000}" for i in range(120_000)) + "."


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(
        [(i, text, "en", source, None if text is None else len(text), "clash", "clash", 7) for i, text, source in rows],
        schema)


def awkward(spark):
    return table(spark, [
        (0, None, "a"), (1, "", "a"), (2, "one", None), (3, PROSE * 12, "b"), (3, PROSE * 12, "b"),
        (4, PROSE * 12, "a"), (5, "  \n\n \t ", "a"), (6, LONG, "b"), (None, PROSE * 3, "a"),
        (None, None, None), (7, "é漢字 “quoted” \U0001f600 token = abcdefgh", "c"), (8, PROSE * 12 + "More of it.", "c"),
        (20, PROSE * 12, "b"), (22, CLEAN, "c"), (21, "\n".join([PROSE.strip()] * 9), "a"),
    ])


def nothing(spark):
    return table(spark, [])
