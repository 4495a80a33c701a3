"""Kept terms and divergences against counting everything."""

import random
from collections import Counter

import pytest

from corpuskit.llm.divergence import frequent_terms, source_divergence, term_bags
from tests.llm.cases import SCHEMA, awkward, nothing


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y", 1) for i, (t, lang, s) in enumerate(rows)], SCHEMA)


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalpha():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute(rows, least, top=50):
    rows = [(words(t), lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {x for _, x, _ in rows}:
        own = [(w, s) for w, x, s in rows if x == lang]
        df = Counter(w for ws, _ in own for w in set(ws))
        kept = sorted((w for w, n in df.items() if n >= least), key=str.encode)
        counts = {s: Counter() for _, s in own}
        for ws, s in own:
            counts[s].update(w for w in ws if df[w] >= least)
        whole = sum(counts.values(), Counter())

        def share(c, w):
            return 1 + 10 ** 9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(sum(abs(share(c, w) - share(d, w)) for w in kept), o) for o, d in counts.items() if o != s]
            terms = [(share(c, w) - share(whole, w), w) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, i + 1) for i, (v, x) in enumerate(found[:most])]
    return sorted(out)


def sample(seed, n=160):
    rng = random.Random(seed)
    stems = ["a", "ab", "abc", "abcd", "abcde" * 9, "z" * 70, "naïve", "ÀÉ", "漢字", "漢", "don", "T", "İ", "ǅ"]
    pool = stems + [x + y for x in stems for y in ("s", "ing", "é", "Q")]
    return [(" ".join(rng.choice(pool) + rng.choice(["", ".", "-1", "\0"]) for _ in range(rng.randint(0, 30))),
             rng.choice(["en", "en", "de", None, "fr"]), rng.choice(["a", "b", "é", "", None, "src9", "src10"]))
            for _ in range(n)] + [("rare word", "xx", "a"), (None, "xx", "b")]


@pytest.mark.parametrize("least, bits", [(3, 24), (12, 6), (1000, 24)])
def test_divergence_is_that_of_all_counts(spark, least, bits):
    rows = sample(least)
    found = source_divergence(docs(spark, rows), least_docs=least, bits=bits)
    assert dict(found.dtypes)["rank"] == "int" and dict(found.dtypes)["value"] == "bigint"
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, least)


def test_prefixes_lead_to_the_frequent_terms(spark):
    rows = sample(5)
    for least in (1, 2, 9):
        df = {}
        for text, lang, _ in rows:
            for w in set(words(text)):
                df[lang or "", w] = df.get((lang or "", w), 0) + 1
        found = frequent_terms(term_bags(docs(spark, rows)), least).collect()
        assert sorted(tuple(r) for r in found) == sorted((*k, n) for k, n in df.items() if n >= least)


def test_several_blocks_and_parts(spark, monkeypatch):
    from corpuskit.llm import divergence

    monkeypatch.setattr(divergence, "BLOCK", 3)
    monkeypatch.setattr(divergence, "GROUP_ROWS", 20)
    rows = [(t, "x", f"s{i % 8}") for i, (t, _, _) in enumerate(sample(8))]
    assert sorted(tuple(r) for r in source_divergence(docs(spark, rows), least_docs=4, top=3).collect()) == brute(rows, 4, 3)


def test_shares_beyond_64_bits(spark):
    rows = [("a b " * 30, "x", "s"), ("a c", "x", "t"), ("b c c", "x", "t")]
    big = 10 ** 17
    found = {tuple(r)[:5] for r in source_divergence(docs(spark, rows), least_docs=1, scale=big).collect()}
    a, b = (1 + big * (n + 5) // (total + 15) for n, total in ((30, 60), (31, 65)))
    assert ("x", "s", "term", "a", a - b) in found


def test_divergence_takes_awkward_rows(spark):
    rows = [(r.text, r.lang, r.source) for r in awkward(spark).collect()]
    found = source_divergence(awkward(spark), least_docs=2).collect()
    assert sorted(tuple(r) for r in found) == brute(rows, 2)
    assert source_divergence(nothing(spark)).count() == 0
