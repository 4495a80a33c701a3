"""Block-wise operators against brute force, with one key holding most rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from corpuskit.operators import ordered as od
from corpuskit.operators import quality as ql
from corpuskit.operators.skew import join_copies
from corpuskit.operators.traces import stage_latency


def rows():
    rng = random.Random(5)
    return [("hot" if i % 3 else f"k{i % 7}", i, rng.randint(0, 9)) for i in range(400)]


def grouped():
    out = defaultdict(list)
    for k, p, v in rows():
        out[k].append((p, v))
    return {k: sorted(v) for k, v in out.items()}


def test_running_total_both_ways(spark):
    df = spark.createDataFrame(rows(), "k string, p int, v int")
    block = F.floor(F.col("p") / 16)
    up = od.running_total(df, ["k"], "p", F.col("v"), "s", block=block)
    down = od.running_total(df, ["k"], "p", F.col("v"), "s", descending=True, block=block)
    want_up, want_down = {}, {}
    for k, items in grouped().items():
        s = 0
        for p, v in items:
            s += v
            want_up[k, p] = s
        s = 0
        for p, v in reversed(items):
            s += v
            want_down[k, p] = s
    assert {(r.k, r.p): r.s for r in up.collect()} == want_up
    assert {(r.k, r.p): r.s for r in down.collect()} == want_down


def test_neighbours(spark):
    df = spark.createDataFrame(rows(), "k string, p int, v int")
    for stepping in (1, -1):
        got = od.with_neighbour(df, ["k"], "p", ["p", "v"], "n", stepping, block=F.floor(F.col("p") / 16))
        want = {}
        for k, items in grouped().items():
            for i, (p, _) in enumerate(items):
                j = i + stepping
                want[k, p] = items[j] if 0 <= j < len(items) else None
        assert {(r.k, r.p): (tuple(r.n) if r.n else None) for r in got.collect()} == want


def test_rank_select(spark):
    df = spark.createDataFrame(rows(), "k string, p int, v int")
    n = F.col("n")
    got = od.rank_select(df, ["k"], "v", {"mid": F.floor(n / 2), "p95": F.floor(n * 0.95)}, bins=4)
    for r in got.collect():
        values = sorted(v for _, v in grouped()[r.k])
        assert (r.n, r.mid, r.p95) == (len(values), values[len(values) // 2], values[int(len(values) * 0.95)])
    one = od.rank_select(df, [], "v", {"mid": F.floor(n / 2)}).first()
    assert one.mid == sorted(v for _, _, v in rows())[200]


def test_join_copies_salts_hot_keys(spark):
    df = spark.createDataFrame(rows(), "k string, p int, v int")
    counted = df.groupBy("k").agg(F.count(F.lit(1)).alias("copies"))
    unique = df.groupBy("k").agg(F.sum("v").alias("total"))
    plain = df.join(unique, "k").select("k", "p", "v", "total")
    salted = join_copies(df, unique, ["k"], counted, hot_rows=20).select("k", "p", "v", "total")
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))


def test_embedding_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)] + [[0.0] * 6]
    data = []
    for i in range(220):
        v = base[0] if i % 3 == 0 else base[rng.randrange(len(base))]
        data.append((i, [x + rng.choice([0.0, 0.0, 4e-7, -4e-7, 1.5e-6]) for x in v]))
    want = {}
    for i, v in data:
        for j, u in data:
            if j < i and all(abs(a - b) <= 1e-6 for a, b in zip(v, u)):
                want[i] = j
                break
    df = spark.createDataFrame(data, "id long, embedding array<double>")
    got = {r.entity_id: r.duplicate_of for r in ql.embedding_duplicates(df, "id").collect()}
    assert got == want


def test_rank_select_with_a_far_outlier(spark):
    """Bins follow the values' own quantiles, so one huge value does not empty the others."""
    df = spark.range(20_001).select((F.col("id") % 2).alias("k"), F.when(
        F.col("id") == 20_000, F.lit(1e12)).otherwise(F.col("id") / 7.0).alias("v"))
    got = {r.k: (r.n, r.mid, r.top) for r in od.rank_select(
        df, ["k"], "v", {"mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1}).collect()}
    assert got[0] == (10_001, 10_000 / 7.0, 1e12) and got[1] == (10_000, 10_001 / 7.0, 19_999 / 7.0)


def test_order_statistics_whatever_cuts_are_found(spark, monkeypatch):
    """Approximate quantiles depend on the order of their rows: two computations may cut in different places."""
    def wander(column, shares, accuracy):
        found = F.udf(lambda low, high: sorted(random.uniform(low, high) for _ in shares), "array<double>")
        return found.asNondeterministic()(F.min(column), F.max(column))

    monkeypatch.setattr(F, "percentile_approx", wander)
    df = spark.range(0, 6000, 1, 6).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    rows = od.rank_select(df, ["k"], "v", {"low": F.lit(0), "mid": F.col("n") / 2, "p95": F.floor(F.col("n") * 0.95)}).collect()
    assert sorted(map(tuple, rows)) == [(k, 3000, 0.0 + k, 3000.0 + k, 5700.0 + k) for k in (0, 1)]


def test_stage_latency_keeps_groups_without_a_name(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "a", 3.0), ("m", "a", 5.0)], "model string, stage string, ms double")
    rows = {r.model: (r.n, r.mean_ms, r.p50_ms, r.share) for r in stage_latency(df, ["model"]).collect()}
    assert rows == {None: (2, 2.0, 2.0, 1.0), "m": (1, 5.0, 5.0, 1.0)}
