"""Sharding: its law, its slots and its groups."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpuskit.llm.sharding import OVERFULL, Splitters, deal, range_number, shard_places, splitters, write_shards
from tests.llm.cases import awkward, nothing, table


def test_place_counts_the_boundaries():
    rng = np.random.default_rng(2)
    cut = Splitters(rng.integers(0, 30, 60), rng.integers(-1, 5, 60))
    keys = [(g, u) for g in range(-1, 32) for u in range(6)]
    pairs = list(zip(cut.groups.tolist(), cut.rows.tolist()))
    want = [sum(p <= k for p in pairs) for k in keys]
    assert cut.place(*np.array(keys).T).tolist() == want and pairs == sorted(set(pairs))


def test_deal_evens_out():
    sizes = np.random.default_rng(3).integers(1, 1000, 500).tolist()
    filled = [0] * 16
    for size, shard in zip(sizes, deal(sizes, 16)):
        filled[shard] += size
    assert max(filled) - min(filled) <= 20


@pytest.mark.parametrize("sizes", [
    [1] * 3000, [10 ** 6] + [5] * 3000, [1 + (i * i) % 977 for i in range(3000)]])
def test_no_range_is_too_full(spark, sizes):
    # A third of the rows are one group.
    rows = [(0 if i % 3 == 0 else 2 * (i * 7919 % 100_003), i, s) for i, s in enumerate(sizes)]
    keys = spark.createDataFrame(rows, "group long, uid long, size long").cache()
    cut = splitters(keys, 64)
    got = keys.withColumn("range", range_number(cut)).groupBy("range").agg({"size": "sum", "*": "count"}).toPandas()
    alone = got["count(1)"] == 1
    assert (got["sum(size)"][~alone] <= OVERFULL * sum(sizes) / 64).all()
    assert (got["count(1)"] <= OVERFULL * 3000 / 64).all()


def by_shard(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.shard].append(r)
    for own in out.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return out


def test_shards_are_even_and_keep_small_groups(spark):
    texts = [f"text {i % 700} " * (1 + i % 40) for i in range(2000)] + ["hot " * 30] * 900
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    rows = shard_places(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    sums = [sum(r.size for r in own) for own in by_shard(rows).values()]
    assert len(sums) == 16 and max(sums) <= 1.02 * min(sums)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if t != "hot " * 30)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = awkward(spark).union(awkward(spark))
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = back.collect()
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    by_shard(rows)
    places = {(r.doc_id, r.shard, r.slot) for r in shard_places(docs, 4).collect()}
    assert {s for _, s, _ in places} == {r.shard for r in rows}


def test_sharding_takes_awkward_rows(spark):
    rows = shard_places(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count() and {r.size for r in rows if r.doc_id in (0, 1)} == {1}
    by_shard(rows)
    assert shard_places(nothing(spark)).count() == 0
    same = table(spark, [(1, "x", "a")] * 500)
    assert {len(own) for own in by_shard(shard_places(same, 5).collect()).values()} == {100}


def test_query_types(spark):
    from corpuskit.llm.workload import BOOK

    df = BOOK.queries["op11_sampled_sharding"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"),
                         ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
