"""Token counts, packing, mixing: exact against the library, round trips, moments."""

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from corpuskit.llm.mixing import mix, poisson_count, source_rates
from corpuskit.llm.packing import best_fit_decreasing, best_fit_packing, lower_bound, pack
from corpuskit.llm.token_counts import token_counts
from corpuskit.llm.tokenizing import encode, word_ids
from corpuskit.llm.workload import tokenizer_file
from tests.llm.cases import LONG, awkward, nothing, table

BYTE, WORDS = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("word_bpe_49k.json")
ODD = [
    "It's  a \n\n test\t\tof 123 ½ ²x  ", "<|endoftext|> hi", "ÀÉ İstanbul ﬁ é K  x\x1cy",
    "''s don't DON'T I'LL", "   lead", "a b", "“quoted” – dash… €5", "ABC<|startoftext|>d", "ͅx ǅ ß ſ",
    "漢字かな \U0001f600\U0001f1e9\U0001f1ea é", "\r\n\r\n x y", "",
]


def test_ids_are_the_library_s():
    for text in ODD + [LONG[:20000]]:
        assert np.frombuffer(word_ids(WORDS, text), "<u4").tolist() == encode(WORDS, text)


def test_token_counts(spark):
    docs = table(spark, [(i, t, "a") for i, t in enumerate(ODD)])
    for row in token_counts(docs, BYTE).collect() + token_counts(awkward(spark), BYTE).collect():
        n = len(encode(BYTE, row.text or ""))
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (n, len((row.text or "").encode()), n > 512)
        assert row.n_words == "clash"
    assert token_counts(nothing(spark), BYTE).count() == 0


def checked(rows, capacity=2048):
    """Sequences are gapless from 0 and hold at most the capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_holds_every_token(spark):
    docs = awkward(spark)
    rows = best_fit_packing(docs, WORDS).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    for key, own in texts.items():
        want = []
        for text in own:
            ids = np.array(encode(WORDS, text) + [0], "<u4")
            want += [(i, s, min(2048, len(ids) - s), zlib.crc32(ids[s:s + 2048].tobytes()))
                     for i, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[key]) == sorted(want)
    used = checked(rows)
    assert used == -(-sum(r.length for r in rows) // 2048)
    assert best_fit_packing(nothing(spark), WORDS).count() == 0


def fewest_bins(sizes, capacity):
    """By trying everything."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, bins + [sizes[i]])

    place(0, [])
    return best[0]


def test_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(150):
        capacity = int(rng.choice([10, 24, 60]))
        sizes = rng.integers(1, capacity + 1, rng.integers(1, 9))
        best = fewest_bins(sorted(sizes.tolist(), reverse=True), capacity)
        bins, _ = best_fit_decreasing(sizes, capacity)
        assert lower_bound(sizes, capacity) <= best <= bins.max() + 1
    # Items over a third and under a half: the plain sum says too little.
    assert lower_bound(np.array([7] * 9), 20) == 5


def test_exchange_never_costs_a_bin(spark):
    rng = np.random.default_rng(7)
    for lengths in (rng.integers(1, 2048, 900), rng.integers(690, 1300, 700), np.full(300, 683)):
        df = spark.createDataFrame(pd.DataFrame({"length": lengths.astype("int64")}))
        used = [checked(pack(df, part_rows=100, rounds=n).collect()) for n in (1, 4)]
        assert lower_bound(lengths, 2048) <= used[1] <= used[0]


@pytest.mark.parametrize("rate", [0.01, 0.7, 3.0, 40.0, 2000.0])
def test_inversion_is_poisson(spark, rate):
    from pyspark.sql import functions as F

    n = 2000 if rate < 1000 else 200
    df = spark.range(n).select(poisson_count(F.lit(rate), (F.col("id") + 0.5) / n).alias("k"))
    mean, var = df.agg(F.avg("k"), F.var_pop("k")).first()
    assert abs(mean - rate) < 0.02 * rate + 0.02 and abs(var - rate) < 0.15 * rate + 0.02


def test_mixing(spark):
    docs = table(spark, [(i, "x" * 100, "big" if i % 10 else "small") for i in range(4000)])
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    rates = dict(source_rates(docs, weights).collect())
    assert rates["big"] == pytest.approx(1 / 1.8) and rates["small"] == pytest.approx(5.0)
    rows = mix(docs, weights).collect()
    share = sum(r.source == "small" for r in rows) / len(rows)
    assert abs(share - 0.5) < 0.05 and abs(len(rows) - 4000) < 300
    assert sorted(rows) == sorted(mix(docs, weights).collect())
    assert all(1 <= r.copy <= r.copies for r in rows) and rows[0]._text == "clash"
    only = spark.createDataFrame([("small", 2.0)], "source string, weight double")
    assert {r.source for r in mix(docs, only).collect()} == {"small"}


def test_mixing_awkward_rows(spark):
    docs = awkward(spark)
    assert {r.doc_id for r in mix(docs).collect()} <= {r.doc_id for r in docs.collect()}
    assert mix(nothing(spark)).count() == 0
