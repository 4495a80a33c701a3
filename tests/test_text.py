import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators import cleaning
from corpuskit.session import ship_package


def run(spark, build, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("text"))).collect()]


def step(spark, fn, text, **kw):
    df = spark.createDataFrame([(text,)], "text string")
    return fn(df, **kw).first()["text"]


def test_space_set_is_pythons():
    assert all(c.isspace() for c in tx.SPACE_CHARS)
    assert {chr(i) for i in range(0x3001) if chr(i).isspace()} == set(tx.SPACE_CHARS)


@pytest.mark.parametrize("raw,want", [
    ("hello     world   here", "hello world here"),
    ("  a  \n\tb\t\n", "a\nb"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("", ""),
    (" x \r\ny\x0bz ", "x\ny\nz"),
])
def test_clean_whitespace(spark, raw, want):
    assert run(spark, tx.clean_whitespace, raw) == [want]


def test_unicode(spark):
    raw = "“Hi” – it’s—fine… • A​B﻿ ﬁ"
    want = unicodedata.normalize("NFKC", raw)
    assert run(spark, tx.nfkc, raw, "plain") == [want, "plain"]
    assert run(spark, tx.replace_typographic, "“Hi” – it’s—fine… •") == ["\"Hi\" - it's--fine... *"]
    assert run(spark, tx.strip_invisible, "A​B﻿") == ["AB"]


def test_page_lines(spark):
    drop = cleaning.drop_page_lines
    assert step(spark, drop, "Content\nPage 3 of 10\nMore content") == "Content\nMore content"
    assert step(spark, drop, "Some content\n\n- 42 -\n\nMore") == "Some content\n\n\nMore"
    assert step(spark, drop, "t\n1\n2\n3\nu") == "t\n1\n2\n3\nu"
    assert step(spark, drop, "") == ""


def test_headers_and_footers(spark):
    page = lambda n: f"ACME\n{'body ' * 20}{n}\nfoot"
    body = lambda n: f"{'body ' * 20}{n}"
    text = "\f".join([page(1), page(2), "short"])
    drop = cleaning.drop_repeated_headers_footers
    assert step(spark, drop, text) == "\n\n".join([body(1), body(2), "short"])
    assert step(spark, drop, text, keep_short=False) == "\n\n".join([body(1), body(2)])
    assert step(spark, drop, page(1)) == page(1)


def test_words_and_language(spark):
    assert run(spark, tx.word_count, "a b c \x1c d", "", "  ") == [4, 0, 0]
    english, other = "the cat and the dog are in the house", "eins zwei drei vier"
    assert run(spark, tx.detect_language_en, english, other, " ") == ["en", None, None]


def test_titles_keywords_dates(spark):
    assert run(spark, tx.title_from_path, "/a/my_big-file.txt", "/a/---.md", "/a/.env") == [
        "my big file", "---.md", ".env"]
    assert run(spark, tx.parse_keywords, "a, b;; c ,") == [["a", "b", "c"]]
    got = run(spark, tx.parse_pdf_date, "D:20240131120000+01'00'", "nope", None)
    assert [str(g) for g in got] == ["2024-01-31 12:00:00", "None", "None"]
    got = run(spark, tx.parse_iso_or_epoch, "2024-01-31T12:00:00", "0", "x")
    assert [str(g) for g in got] == ["2024-01-31 12:00:00", "1970-01-01 00:00:00", "None"]


def test_default_order(spark):
    df = spark.createDataFrame([("“A”   b\n\n\n\n7\n\nend… ",)], "text string")
    assert cleaning.clean(df).first()["clean_text"] == '"A" b\n\nend...'


def test_batches_of_long_texts_are_bounded_by_their_bytes(spark):
    """A worker holds a whole batch: 400 rows of 100 kB are not one."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    session = spark.newSession()
    ship_package(session)
    long = session.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 40_000_000 and max(found) <= 20_000_000
