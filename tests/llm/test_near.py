"""Line dedup, near-duplicates and components against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from corpuskit.llm.alignment import edit_distance, within
from corpuskit.llm.components import components
from corpuskit.llm.line_dedup import FEWEST_WORDS, line_dedup, normalised, simhash, voters
from corpuskit.llm.order_minhash import hash_cache, near_duplicates, one_of_each, similar, sketch, word_hashes
from tests.llm.cases import PROSE, awkward, nothing, table


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_edit_distance():
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randint(0, 4) for _ in range(rng.randint(0, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 10)):
            kind = rng.random()
            if kind < 0.3 and b:
                b.pop(rng.randrange(len(b)))
            elif kind < 0.6:
                b.insert(rng.randint(0, len(b)), rng.randint(0, 4))
            elif b:
                b[rng.randrange(len(b))] = rng.randint(0, 4)
        true = plain_distance(a, b)
        for limit in (0, 1, 2, 5, 9, 20):
            assert within(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (true <= limit)


def groups_of(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [
        (1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    links = [(a, b) for a, b in links if a != b]
    assert got == groups_of(links, {x for pair in links for x in pair})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def varied(spark):
    """Near copies by word edits, a long chain of them, and unrelated texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for edits in (0, 0, 2, 6, 12, 40):
            text = list(base)
            for _ in range(edits):
                at = rng.randrange(len(text))
                text[at:at + rng.randint(0, 2)] = [rng.choice(words)]
            rows.append((i, " ".join(text), f"s{i % 3}"))
            i += 1
    return table(spark, rows)


def test_near_duplicates(spark):
    docs = varied(spark)
    rows = {r.doc_id: r.text for r in docs.collect()}
    cache = hash_cache()
    hashes = {i: word_hashes(t, cache) for i, t in rows.items()}
    alike = [(a, b) for a, b in combinations(sorted(rows), 2) if similar(hashes[a], hashes[b], 0.8)]
    links = [(a, b) for a, b in alike if len(np.intersect1d(sketch(hashes[a]), sketch(hashes[b])))]
    assert len(links) >= 0.9 * len(alike) > 50
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    want = groups_of(links, rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.class_size == sum(c == r.class_id for c in want.values()) for r in got.values())
    kept = one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == docs.columns


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    got = [(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()]
    assert len(got) == docs.count()
    classes = dict(got)
    assert classes[3] == classes[4] == classes[20] == classes[8] == 3
    assert classes[0] == classes[1] == classes[5] == 0 and classes[None] is None
    kept = one_of_each(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (False, 2), (False, 3), (False, 6), (False, 7), (False, 21), (False, 22), (True, 0), (True, 0)]
    assert {r.n_words for r in near_duplicates(docs.filter('doc_id IS NULL')).collect()} == {0, 45}
    assert near_duplicates(nothing(spark)).count() == 0 and one_of_each(nothing(spark)).count() == 0


def test_a_bucket_shared_by_all_loses_no_link(spark):
    """Many texts with one common passage and a few true pairs among them."""
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(40):
        own = [f"o{i}x{k}" for k in range(60)]
        rows.append((2 * i, passage + " " + " ".join(own), "a"))
        own[rng.randrange(60)] = "changed"
        rows.append((2 * i + 1, passage + " " + " ".join(own), "a"))
    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def brute_lines(docs):
    """The definition, with all pairs of distinct lines."""
    cache = hash_cache()
    places, shown = {}, {}
    for i, text in sorted(docs):
        for n, line in enumerate(text.split("\n")):
            if len(line.split()) >= FEWEST_WORDS:
                places.setdefault(normalised(line), []).append((i, n))
    for line in places:
        words = np.array([cache[w] for w in voters(line.split())], np.uint64)
        shown[line] = int(simhash(words, np.array([0]))[0])
    links = []
    for a, b in combinations(places, 2):
        if bin(shown[a] ^ shown[b]).count("1") <= 3:
            x, y = (np.array([ord(c) for c in s]) for s in (a, b))
            if within(x, y, int(0.1 * max(len(x), len(y)) + 1e-9)):
                links.append((min(places[a]), min(places[b])))
    group = groups_of(links, [min(p) for p in places.values()])
    gone = {p for ps in places.values() for p in ps if p != group[min(ps)]}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}, links


def test_line_dedup(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    pool = [[rng.choice(words) for _ in range(rng.randint(3, 150))] for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            if rng.random() < 0.6:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(("  " if rng.random() < 0.3 else "") + " ".join(line).title())
        docs.append((i, "\n".join(lines)))
    want, links = brute_lines(docs)
    assert len(links) > 10
    out = line_dedup(table(spark, [(i, t, "a") for i, t in docs])).collect()
    assert {r.doc_id: r.text for r in out} == want
    assert all(r.n_lines == dict(docs)[r.doc_id].count("\n") + 1 for r in out)
    assert sum(r.n_removed for r in out) > 50


def test_line_dedup_of_awkward_rows(spark):
    docs = awkward(spark)
    out = line_dedup(docs).collect()
    assert len(out) == docs.count() and set(docs.columns) <= set(out[0].asDict())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.text for r in by[0]] == [None] and [r.text for r in by[1]] == [""]
    assert [r.text for r in by[3]] == [PROSE * 12] * 2 and [r.text for r in by[4]] == [""]
    assert [r.text for r in by[21]] == [PROSE.strip()] and by[21][0].n_removed == 8
    assert sorted(r.text or "" for r in by[None]) == ["", PROSE * 3]
    assert line_dedup(nothing(spark)).count() == 0


@pytest.mark.parametrize("distance", range(6))
def test_block_keys_meet_within_the_radius(spark, distance):
    from pyspark.sql import functions as F

    from corpuskit.llm.line_dedup import BLOCKS, RADIUS, block_keys

    rng = random.Random(distance)
    rows = []
    for _ in range(50):
        x = rng.getrandbits(63)
        rows.append((x, x ^ sum(1 << k for k in rng.sample(range(63), distance))))
    df = spark.createDataFrame(rows, "x long, y long")
    meet = F.arrays_overlap(block_keys("x", RADIUS, BLOCKS), block_keys("y", RADIUS, BLOCKS))
    shared = df.filter(meet).count()
    assert shared == 50 if distance <= RADIUS else shared < 50


def test_edit_distance_by_bit_vectors():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert edit_distance(np.array(a, np.int64), np.array(b, np.int64)) == plain_distance(a, b)


def edited_lines():
    """(line, its copy with one to four changed words, words), edit similarity 0.9 or more, of all lengths."""
    rng = random.Random(17)
    out = []
    for n in (5, 8, 11, 15, 25, 40, 70, 120):
        while sum(size == n for *_, size in out) < 20:
            line = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)]
            copy = list(line)
            for at in rng.sample(range(n), rng.randint(1, max(1, min(4, n // 10)))):
                copy[at] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 5)))
            x, y = " ".join(line), " ".join(copy)
            if 0 < plain_distance(x, y) <= 0.1 * max(len(x), len(y)):
                out.append((x, y, n))
    return out


def test_queries_find_lines_by_edit_similarity_alone(spark, tmp_path):
    """Recall without a condition on fingerprints, in the query and in the stage."""
    import corpus_pipeline
    from corpuskit.llm.workload import BOOK

    pairs = edited_lines()
    rows = [(2 * i + k, pair[k], "a") for i, pair in enumerate(pairs) for k in range(2)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    gone = {r.doc_id for r in BOOK.queries["op2_line_dedup"](spark, str(tmp_path)).collect() if r.n_removed}
    assert all(i % 2 for i in gone)
    for n in {size for *_, size in pairs}:
        assert sum(2 * i + 1 in gone for i, pair in enumerate(pairs) if pair[2] == n) >= 19, n
    # The stage leaves out the documents that have lost their only line.
    kept = {r.doc_id for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()}
    assert {r[0] for r in rows} - kept == gone


def test_short_lines_and_lines_without_blanks(spark):
    """Every non-blank line folds with its equals; ten characters allow the first edit."""
    rng = random.Random(8)
    solid = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60))
    near = solid[:30] + "x" + solid[31:]
    docs = [(1, "Menu\n\none two\n" + solid), (2, "menu\n\nOne  two\n" + solid), (3, near + "\nmenus\n \none too")]
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(
        table(spark, [(i, t, "a") for i, t in docs]), radius=None).collect()}
    assert out == {1: (docs[0][1], 0), 2: ("", 3), 3: ("menus\n \none too", 1)}


def test_marks_refuse_nothing_within_the_edits():
    from corpuskit.llm.alignment import edit_distance
    from corpuskit.llm.line_dedup import odd_classes
    from corpuskit.llm.order_minhash import presence

    rng, flips = random.Random(5), lambda x, y: int(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum())
    for _ in range(200):
        a = [rng.choice("abcde ") for _ in range(rng.randrange(2, 80))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = rng.choice(["", "x", "b"])
        x, y = (np.frombuffer("".join(s).encode("utf-32-le"), np.uint32) for s in (a, b))
        marks = odd_classes(["".join(a), "".join(b)])
        assert flips(marks[0], marks[1]) <= 4 * edit_distance(x, y)
        assert flips(presence(x.astype(np.uint64)), presence(y.astype(np.uint64))) <= 2 * edit_distance(x, y)
    # A word that stands elsewhere, too, is missed.
    words = np.array([1, 2, 1, 2, 1, 2], np.uint64)
    assert flips(presence(words), presence(np.array([1, 2, 1, 2, 1, 1], np.uint64))) == 2
    assert flips(*odd_classes(["an open line with words", "one more thing to be seen"])) > 4 * 2


def test_marks_tell_repeated_words_apart():
    """A word that stands twice in one text and not in the other changes marks, and so does a difference in length."""
    from corpuskit.llm.order_minhash import presence

    def flips(x, y):
        marks = [presence(np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.uint64) for words in (x, y)]
        return int(np.bitwise_count(marks[0] ^ marks[1]).sum())

    passage = [1, 2] * 60
    x, y = [*range(10, 30)] * 2 + passage, [*range(40, 60)] * 2 + passage
    assert plain_distance(x, y) == 40 and 70 <= flips(x, y) <= 80
    rng = random.Random(13)
    for _ in range(100):
        a = [rng.randrange(9) for _ in range(rng.randrange(1, 60))]
        b = [w for w in a if rng.random() > 0.2] + [rng.randrange(9) for _ in range(rng.randrange(6))]
        assert flips(a, b) <= 2 * plain_distance(a, b) - abs(len(a) - len(b))


def test_a_band_is_not_widened_for_texts_too_far_apart(monkeypatch):
    """The same words in another order: the words agree, the alignment does not."""
    from corpuskit.llm import alignment

    rng, bands = random.Random(3), []
    a = np.array([rng.randrange(40) for _ in range(300)], np.int64)
    b = np.array(rng.sample(a.tolist(), 300), np.int64)
    plain = alignment.banded
    monkeypatch.setattr(alignment, "banded", lambda x, y, band: bands.append(band) or plain(x, y, band))
    assert not within(a, b, 60) and bands == []
    assert within(a, b, plain_distance(a, b)) and len(bands) == 1


def test_pairs_side_by_side_are_asked_as_one_by_one():
    from corpuskit.llm import alignment

    rng, first, second, limits, want = random.Random(21), [], [], [], []
    for turn in range(3000):
        letters = "abcdef" if turn % 3 else "abc\u6f22\U0001f600\U0001f601"
        a = [rng.choice(letters) for _ in range(rng.choice((0, 1, 2, 5, 12, 40, 90)))]
        b = list(a) if turn % 10 else [rng.choice(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9, 20))):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
        x, y = (np.frombuffer("".join(z).encode("utf-32-le"), np.uint32) for z in (a, b))
        distance = edit_distance(x, y)
        first.append(x), second.append(y), limits.append(max(0, distance + rng.randrange(-3, 4)))
        want.append(distance <= limits[-1])
    got = alignment.within_each(first, second, np.array(limits))
    assert got.tolist() == want and 0.2 < np.mean(want) < 0.9
    assert alignment.within_each([], [], np.array([], np.int64)).tolist() == []
    # Longer ones, one by one, and the same rows in numbers beyond two bytes.
    long = np.array([rng.randrange(5) for _ in range(4000)], np.uint32)
    changed = np.delete(long, slice(7, 3500, 50)) + np.uint32(70_000)
    assert alignment.within_each([long + np.uint32(70_000)] * 2, [changed] * 2, np.array([70, 69])).tolist() == [True, False]


def test_pairs_side_by_side_take_less_time():
    import time

    from corpuskit.llm.alignment import within_each, within_limit

    rng, first, second = random.Random(22), [], []
    base = [rng.randrange(97, 123) for _ in range(400)]
    for _ in range(1500):
        for side in (first, second):
            line = list(base)
            for at in rng.sample(range(400), 36):
                line[at] = rng.randrange(97, 123)
            side.append(np.array(line, np.uint32))
    limits = np.full(len(first), 40)
    start = time.perf_counter()
    one_by_one = [within_limit(x, y, 40) for x, y in zip(first, second)]
    between = time.perf_counter()
    assert within_each(first, second, limits).tolist() == one_by_one
    assert time.perf_counter() - between < (between - start) / 2


def test_hashes_of_many_words_are_those_of_single_ones():
    import xxhash

    from corpuskit.llm.hashing import part_hashes

    rng = random.Random(23)
    words = ["", "x"] + ["".join(rng.choice("ab1\u00e9\u6f22\U0001f600") for _ in range(n)) for n in range(41) for _ in range(30)]
    raw = " ".join(words).replace(" x ", "\nx\n").encode()
    assert part_hashes(raw).tolist() == [xxhash.xxh3_64_intdigest(w.encode()) for w in words]
    assert part_hashes(b"").tolist() == [xxhash.xxh3_64_intdigest(b"")]


def test_texts_are_read_once_for_the_lines_that_are_compared(spark, monkeypatch):
    """Not once more for each round of comparisons."""
    from corpuskit.llm import line_dedup as module

    labels, plain = [], module.kept_table
    monkeypatch.setattr(module, "kept_table", lambda df, label: labels.append((label, df.inputFiles())) or plain(df, label))
    rng = random.Random(24)
    words = [f"w{i}" for i in range(900)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):
        line = list(base)
        for at in rng.sample(range(60), rng.randrange(9)):
            line[at] = rng.choice(words)
        rows.append((i, " ".join(line), "a"))
    docs = plain(table(spark, rows), "documents")
    source = set(docs.inputFiles())
    out = {r.doc_id: r.n_removed for r in line_dedup(docs, radius=None).collect()}
    assert sum(name == "pairs" for name, _ in labels) >= 2
    assert [name for name, files in labels if source & set(files)] == ["lines", "shared"]
    # As comparing all pairs.
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, t, _ in rows]
    links = [(a, b) for a, b in combinations(range(60), 2)
             if within(points[a], points[b], int(0.1 * max(len(points[a]), len(points[b])) + 1e-9))]
    want = groups_of(links, range(60))
    assert out == {i: int(want[i] != i) for i in range(60)}
