import random

import pytest

from corpuskit.operators import chunking as ch


def chunks(spark, text, strategy, pages=None, **kw):
    df = spark.createDataFrame([(1, text, pages or [])], "doc_id long, text string, pages array<string>")
    return ch.chunk(df, strategy, **kw).orderBy("chunk_index").collect()


@pytest.mark.parametrize("strategy", ["fixed", "recursive", "heading_aware"])
def test_empty_and_small(spark, strategy):
    assert chunks(spark, "", strategy) == []
    got = chunks(spark, "  one line  ", strategy)
    assert [c.text for c in got] == ["one line"] and got[0].chunk_id == "1#0"


def test_fixed_windows_cover_and_overlap(spark):
    text = "word " * 300
    got = chunks(spark, text, "fixed", size=100, overlap=20)
    assert got[0].start_offset == 0 and max(c.end_offset for c in got) == len(text)
    for a, b in zip(got, got[1:]):
        assert a.start_offset < b.start_offset <= a.end_offset
        assert b.start_offset == a.end_offset - 20 or b.start_offset == a.end_offset
    # a tail of exactly the overlap follows the window that reached the end
    assert got[-1].end_offset - got[-1].start_offset == 20


def test_fixed_prefers_first_separator_present(spark):
    got = chunks(spark, "aaa. bbb\n\nccc. ddd eee fff", "fixed", size=14, overlap=0)
    assert [c.text for c in got] == ["aaa. bbb", "ccc.", "ddd eee fff"]


def test_recursive_levels_and_merging(spark):
    text = "# A\n" + "x" * 30 + ". " + "y" * 30 + ".\n\n" + "z z z"
    got = chunks(spark, text, "recursive", size=40, min_size=10)
    assert [c.text for c in got] == ["# A\n" + "x" * 30 + ".", "y" * 30 + ".\nz z z"]
    got = chunks(spark, "a b " * 20, "recursive", size=10, min_size=5)
    assert [c.text for c in got] == ["\n".join(["a", "b"] * 20)]


DOC = "intro text that is longer than thirty\n\n# One\n\nparent words\n\n## Two\n\nleaf words of section two, long\n\n# Three\n\ntiny\n"


def test_heading_tree(spark):
    got = chunks(spark, DOC, "heading_aware", overlap=0)
    assert [(c.section, c.heading) for c in got] == [("(preamble)", "(preamble)"), ("# > ##", "##")]
    # the short last section joins the chunk before it; text above a deeper heading is no leaf
    assert got[1].text == "## Two\n\nleaf words of section two, long\n\n# Three\n\ntiny"
    assert "parent words" not in got[0].text + got[1].text
    kept = chunks(spark, DOC, "heading_aware", overlap=0, keep_parent_text=True, heading_text="line")
    assert [(c.section, c.text) for c in kept] == [
        ("(preamble)", "intro text that is longer than thirty\n\n# One\n\nparent words"),
        ("# One > ## Two", "## Two\n\nleaf words of section two, long\n\n# Three\n\ntiny")]


def test_heading_overlap_and_pages(spark):
    got = chunks(spark, DOC, "heading_aware", overlap=6, pages=["p" * 40, "q" * 20, "r" * 5])
    assert got[0].text == "intro text that is longer than thirty\n\n## Two"
    assert [c.page_number for c in got] == [1, 3]


def test_large_section_packs_paragraphs_then_sentences(spark):
    para = "# H\n\n" + "\n\n".join(f"para {i} " + "w" * 30 for i in range(4))
    got = chunks(spark, para, "heading_aware", size=90, overlap=0)
    assert [c.text for c in got] == [
        "# H\n\npara 0 " + "w" * 30 + "\n\npara 1 " + "w" * 30,
        "para 2 " + "w" * 30 + "\n\npara 3 " + "w" * 30]
    text = para
    assert [text[c.start_offset:c.start_offset + 6] for c in got] == ["# H\n\np", "para 2"]
    sent = " ".join(f"Sentence {i} ends here." for i in range(6))
    got = chunks(spark, sent, "heading_aware", size=50, overlap=0)
    assert [c.text for c in got] == [
        f"Sentence {i} ends here. Sentence {i + 1} ends here." for i in (0, 2, 4)]
    got = chunks(spark, "x" * 250, "heading_aware", size=100, overlap=0)
    assert [len(c.text) for c in got] == [100, 100, 50]


def test_headings_table(spark):
    df = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    rows = ch.extract_headings(df, heading_text="line").orderBy("heading_index").collect()
    assert [(r.level, r.title) for r in rows] == [(1, "# One"), (2, "## Two"), (1, "# Three")]
    assert all(DOC[r.start_offset:].startswith(r.title) for r in rows)


@pytest.mark.parametrize("prefix,level", [("# ", 1), ("### ", 3), ("Chapter 4", 1), ("1. ", 1), ("2.3 ", 2), ("odd", 2)])
def test_levels(spark, prefix, level):
    from pyspark.sql import functions as F

    assert spark.range(1).select(ch.heading_level(F.lit(prefix))).first()[0] == level


def test_offsets_are_the_places_of_the_pieces(spark):
    """Double blanks, several blank lines and tiny sections move nothing."""
    rng = random.Random(1)
    texts = []
    for _ in range(60):
        parts = []
        for n in range(rng.randint(1, 6)):
            parts.append(rng.choice(["# H\n\n", f"{n}. Title\n", "", "CHAPTER 2\n\n\n"]))
            parts.append(rng.choice(["  ", "\n\n\n", " ", "\n\n"]).join(
                f"Word{rng.randint(0, 9)} {'w' * rng.randint(1, 30)}." for _ in range(rng.randint(1, 9))) + "\n\n")
        texts.append("".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = ch.chunk(df, "heading_aware", size=70, overlap=0).orderBy("doc_id", "chunk_index").collect()
    assert len(rows) > 200
    for r in rows:
        assert texts[r.doc_id][r.start_offset:r.end_offset].split() == r.text.split()


def test_page_of_a_merged_chunk_is_that_of_its_end(spark):
    text = "# A\n\n" + "a" * 45 + "\n\n# B\n\nshort"
    got = chunks(spark, text, "heading_aware", overlap=0, pages=["p" * 20, "q" * 100])
    assert [(c.start_offset, c.end_offset, c.page_number) for c in got] == [(0, len(text), 2)]


def test_a_level_with_one_piece_leaves_the_segment_whole(spark):
    text = "  \n\n" + "word " * 12
    got = chunks(spark, text, "recursive", size=40, min_size=10)
    assert got[0].start_offset == 0 and got[-1].end_offset <= len(text)
    assert "".join(c.text for c in got).replace("\n", "") == "word" * 12


def test_heading_aware_is_linear(spark):
    """Eight times the text must not take far more than eight times as long."""
    import time

    from pyspark.sql import functions as F

    took = []
    for n in (1, 8):
        df = spark.createDataFrame([(1, "Some plain words end here. " * 20_000 * n)], "doc_id long, text string")
        best = 1e9
        for _ in range(2):
            began = time.time()
            ch.chunk(df, "heading_aware").agg(F.sum("end_offset")).collect()
            best = min(best, time.time() - began)
        took.append(best)
    assert took[1] < 20 * took[0] + 2


def test_very_many_sections_and_segments(spark):
    """Offsets are running totals, not folds that copy what they have."""
    from pyspark.sql import functions as F

    from corpuskit.operators import chunking as ch

    text = "".join(f"# H{i}\n\nbody {i}\n\n" for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    rows = ch.extract_headings(df).filter("doc_id = 1").agg(
        F.count("*"), F.max("end_offset"), F.count_if(F.col("start_offset") < F.col("end_offset"))).first()
    assert tuple(rows) == (30_000, len(text), 30_000)
    words = " ".join("x" * 300 for _ in range(20_000))
    got = ch.chunk(spark.createDataFrame([(1, words)], "doc_id int, text string"), "recursive").agg(
        F.count("*"), F.max("end_offset")).first()
    assert got[0] > 1000 and got[1] > 1_000_000
