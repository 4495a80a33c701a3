"""The stored table against the same changes on plain rows."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import collections as col
from corpuskit.sources.table import StoredTable

FIELDS = "collection string, chunk_id long, text string, n int"


def rows(spark, n, seed, low=0):
    rng = random.Random(seed)
    return spark.createDataFrame(
        [(f"c{i % 3}" if i % 11 else None, i, f"t{rng.random()}", rng.randint(0, 9)) for i in range(low, low + n)], FIELDS)


def table(spark, tmp_path, first):
    out = StoredTable(spark, str(tmp_path / "table"), first.schema, parts=4, buckets=2)
    assert out.insert_ignore(first) == first.count()
    return out


def same(store, want):
    assert sorted(map(str, store.read().select(*want.columns).collect())) == sorted(map(str, want.collect()))


def index_exchanges(df):
    """Exchanges between the table's scan and the join."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :|+-*"))
    above, at = [], depth(plan[scan])
    for line in reversed(plan[:scan]):
        if depth(line) < at:
            above, at = [*above, line], depth(line)
            if "Join" in line:
                return sum("Exchange" in x for x in above)
    raise AssertionError("no join")


def files(store):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{store.path}/part=*/*.parquet")}


def test_writes_equal_those_on_plain_rows(spark, tmp_path):
    first, more = rows(spark, 200, 1), rows(spark, 120, 2, 150)
    store, plain = table(spark, tmp_path, first), first
    before = files(store)
    store.insert_ignore(more.union(more.filter("chunk_id > 250")), ["n"])
    plain = col.insert_ignore(plain, more, ["n"])
    same(store, plain)
    assert before.items() <= files(store).items()
    changes = rows(spark, 30, 3, 240).select("collection", "chunk_id", F.lit("changed").alias("text"))
    store.update_by_id(changes)
    plain = col.update_by_id(plain, changes)
    same(store, plain)
    gone = rows(spark, 60, 4, 20).select("collection", "chunk_id")
    store.delete_by_id(gone)
    plain = col.delete_by_id(plain, gone)
    same(store, plain)
    # Another handle sees the same folder.
    spark.sql(f"DROP TABLE {store.name}")
    same(StoredTable(spark, store.path, first.schema, parts=4, buckets=2), plain)


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    first = rows(spark, 200, 1).filter("collection IS NOT NULL")
    store = table(spark, tmp_path, first)
    before = files(store)
    one = first.filter("chunk_id = 7").select("collection", "chunk_id", F.lit(77).alias("n"))
    store.update_by_id(one)
    after = files(store)
    kept = {p for p in before if after.get(p) == before[p]}
    assert {os.path.dirname(p) for p in kept} and len({os.path.dirname(p) for p in set(after) - kept}) == 1
    store.delete_by_id(first)
    assert store.read().count() == 0
    assert store.insert_ignore(first) == first.count()


def test_the_table_does_not_move(spark, tmp_path):
    first = rows(spark, 200, 1)
    store = table(spark, tmp_path, first)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (store.fresh_rows(rows(spark, 20, 2, 190)), store.merged(rows(spark, 20, 2, 190)),
                   store.remaining(rows(spark, 20, 2, 190))):
            df.write.format("noop").mode("overwrite").save()
            assert index_exchanges(df) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("empty", ["insert", "update", "delete"])
def test_nothing_to_write(spark, tmp_path, empty):
    first = rows(spark, 30, 1)
    store, none = table(spark, tmp_path, first), rows(spark, 0, 1)
    {"insert": store.insert_ignore, "update": store.update_by_id, "delete": store.delete_by_id}[empty](none)
    same(store, first)
