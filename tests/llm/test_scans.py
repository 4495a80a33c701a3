"""License scans and toxicity: fixtures with known answers, held-out accuracy."""

import random
import re
import zlib

import pytest

from corpuskit.llm.license_scan import NOTICES, PHRASES, WORD, license_scan
from corpuskit.llm.toxicity import segments, toxicity
from tests.llm.cases import PROSE, awkward, nothing, table


def base_places(text):
    words = re.findall(WORD, "".join(c.lower() if c.isascii() else c for c in text))
    out = []
    for label, phrase in PHRASES:
        own = phrase.split()
        out += [(i, label) for i in range(len(words) - len(own) + 1) if words[i:i + len(own)] == own]
    return len(words), sorted(out)


def test_license_base(spark):
    texts = ["MIT License, mit-license; the MIT  License.", "The General Public License general public license",
             "general public general public license", "Apache\nLicense ÉMIT license", "mit", "", None,
             (PROSE + " apache license ") * 500]
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    for row in license_scan(docs).collect():
        n, places = base_places(texts[row.doc_id] or "")
        assert (row.n_words, row.n_base) == (n, len(places))
        assert row.first_word == (places[0][0] if places else None)
        assert row.last_word == (places[-1][0] if places else None)
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert (row.score == 1.0) == bool(places) or row.score < 1


def test_license_notices(spark):
    notice = dict(NOTICES)["bsd"]
    words = notice.split()
    changed = " ".join(words[:9] + ["really"] + words[9:])
    rows = [(0, PROSE + notice.upper() + PROSE, "a"), (1, changed, "a"), (2, " ".join(words[:8]), "a"),
            (3, notice + " " + PROSE + notice, "a"), (3, notice + " " + PROSE + notice, "a")]
    out = license_scan(table(spark, rows)).collect()
    labels = {r.doc_id: (r.labels, len(r.spans)) for r in out}
    assert labels == {0: ("bsd", 1), 1: ("bsd", 1), 2: ("", 0), 3: ("bsd", 2)} and len(out) == 5
    assert license_scan(awkward(spark)).count() == awkward(spark).count()
    assert license_scan(nothing(spark)).count() == 0


def test_license_spans_are_verified(spark):
    """Places that are hit twice, or stand in another order, do not add up to a notice."""
    bsd = dict(NOTICES)["bsd"].split()
    half = " ".join(bsd[:len(bsd) // 2])
    back = " ".join(" ".join(bsd[i:i + 3]) for i in range(len(bsd) - 3, -1, -3))
    rows = [(0, "lesser general public general public license", "a"), (1, "gnu lesser general public license", "a"),
            (2, f"{half} {half}", "a"), (3, back, "a"), (4, " ".join(bsd), "a")]
    labels = {r.doc_id: r.labels.split(",") for r in license_scan(table(spark, rows)).collect()}
    assert "lgpl" not in labels[0] and "lgpl" in labels[1]
    assert "bsd" not in labels[2] and "bsd" not in labels[3] and "bsd" in labels[4]


def all_maximal(scores):
    """The definition: take the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    left = all_maximal(scores[:i])
    right = [(s, a + j, b + j) for s, a, b in all_maximal(scores[j:])]
    return left + [(best, i, j)] + right


def test_segments_are_the_maximal_ones():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-4, -3, -2, -1, 1, 2, 3, 5]) * rng.uniform(0.9, 1.1) for _ in range(rng.randint(0, 25))]
        got = [(round(s, 6), a, b) for s, a, b in segments(scores)]
        assert got == [(round(s, 6), a, b) for s, a, b in all_maximal(scores)]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = toxicity(docs.select("doc_id", "text"), labels)
    rows = out.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    bad, good = ([r.score for r in held if r.toxic == t] for t in (1, 0))
    auc = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(bad) * len(good))
    assert auc > 0.95
    assert sum(r.predicted for r in held if r.toxic == 0) < 0.01 * len(good)


def test_toxicity_without_labels_and_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity(awkward(spark), none).collect()
    assert len(rows) == awkward(spark).count() and all(r.score == 0.5 and r.predicted == 0 for r in rows)
    some = spark.createDataFrame([(3, 1, None), (None, 1, 1), (4, 1, 1), (4, 1, 0), (7, 0, 0)],
                                 "doc_id long, quality int, toxic int")
    rows = toxicity(awkward(spark), some).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity(nothing(spark), none).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, stage):
    import corpus_pipeline

    docs = awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, "")
    if stage < 4:
        assert out.columns == docs.columns
    assert out.count() >= 1 and function(spark, docs.limit(0), "").count() == 0
