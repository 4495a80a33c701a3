"""Long groups, deep pages and long change logs."""

import os

from pyspark.sql import functions as F

from corpuskit.operators import catalog as cat
from corpuskit.operators import context as cx
from corpuskit.operators import ordered
from corpuskit.operators import quality as ql
from corpuskit.streaming import jobs


def test_earlier_values_over_blocks(spark):
    rows = [(g, i) for g in "abc" for i in range(0, 60, 1 + ord(g) % 3)]
    df = spark.createDataFrame(rows, "g string, i long")
    found = ordered.earlier_values(df, ["g"], "i", "i", "before", F.floor(F.col("i") / 7)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.before == [i for g, i in rows if g == r.g and i < r.i]


def test_duplicate_chunks_name_all_earlier_ones(spark):
    texts = ["a", "b", "a", "c", "a", "b", ""]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "a")], "doc_id int, chunk_index int, text string")
    got = {r.chunk_index: (r.duplicate_of, r.earlier_copies, r.earlier) for r in ql.duplicate_chunks(df).collect()}
    assert got == {2: (0, 1, [0]), 4: (0, 2, [0, 2]), 5: (1, 1, [1])}


def test_summary_of_a_session_with_a_third_of_all_rows(spark):
    long = [("s0", i, "user" if i % 2 else "bot", f"m{i}") for i in range(1, 3501)]
    rest = [(f"s{1 + i % 900}", i, "user", f"n{i}") for i in range(7000)]
    df = spark.createDataFrame(long + rest, "session_id string, position long, role string, content string")
    rows = {r.session_id: r for r in cx.history_summary(df, 3).collect()}
    pieces = [(f"{r}: " if i % 2 else "") + c for _, i, r, c in long[:-3]]
    assert rows["s0"].text == " | ".join(pieces) and rows["s0"].message_count == 3497
    assert rows["s0"].token_count == sum(len(p) // 4 for p in pieces) and len(rows) == 901


def test_deep_pages_equal_shallow_ones(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), (F.col("id") % 3).alias("tie")).repartition(9)
    order = [F.col("tie").desc(), F.col("x").asc()]
    for page in (1, 33, 50, 51):
        deep = cat.page_of_rows(df, order, page, 100, near_rows=0)
        assert deep.collect() == cat.page_of_rows(df, order, page, 100, near_rows=10 ** 6).collect()
    assert cat.page_of_rows(df.limit(0), order, 2, 10, near_rows=0).count() == 0


def test_status_log_is_merged_and_can_be_replayed(spark, tmp_path):
    schema = "report_id long, ts timestamp, seq long, status string"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    want = {}
    for i in range(7):
        rows = [(r, i, f"s{i}") for r in range(i % 3, 10, 3)]
        want |= {r: s for r, _, s in rows}
        spark.createDataFrame(rows, "report_id long, seq long, status string").select(
            "report_id", F.timestamp_seconds(F.lit(1_000_000 + i)).alias("ts"), "seq", "status",
        ).coalesce(1).write.mode("append").parquet(source)
    for checkpoint in ("c1", "c2"):  # the second job replays every batch over the first one's folders
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.status_table(stream, out, str(tmp_path / checkpoint), merge_every=3).awaitTermination()
        assert {r.report_id: r.status for r in jobs.read_status(spark, out).collect()} == want
        assert len(os.listdir(f"{out}/merged")) == 1 and len(os.listdir(f"{out}/tail")) <= 3
    jobs.merge_status(spark, out, 6)
    assert os.listdir(f"{out}/tail") == [] and os.listdir(f"{out}/merged") == ["upto=6"]
    assert {r.report_id: r.status for r in jobs.read_status(spark, out).collect()} == want
