"""Token alignment against a comparison of all tokens of the two lists."""

import hashlib
from collections import Counter

import pytest

from corpuskit.llm.token_alignment import (
    _byte_of_char, byte_ids, byte_tokenizer, piece_tokenizer, token_alignment)
from corpuskit.llm.workload import tokenizer_file
from tests.llm.cases import LONG, PROSE, awkward, nothing, table

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
TEXTS = [
    "Tokenizers disagree, don't they?", "  two  spaces\tand\n\nlines ", "é漢字 “quoted” \U0001f600 ½ ﬁ", "x", "",
    "<|endoftext|> and <s> </s> <unk> <0x0A> are text", "ǅ ͅ İstanbul \x00 zero", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9,
    PROSE * 4, PROSE * 4, "▁low line▁", "\r\n", "é" * 50,
]


def tokens(text):
    """Both lists as (id, bytes), or nothing where they do not spell the text."""
    if not text:
        return [], []
    alphabet, model = _byte_of_char(), piece_tokenizer(B)
    a = byte_tokenizer(A).encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in byte_tokenizer(A).id_to_token(i))) for i in a.ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return a, b


def placed(own):
    out, at = [], 0
    for i, data in own:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(texts):
    rows, counts = [], Counter()
    for text in texts:
        a, b = map(placed, tokens(text or ""))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, s, e in own if low < e <= high) for own in (a, b)))
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
        counts.update(links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [(
        n_a, n_b, n_groups, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
        hashlib.sha256(written.encode()).hexdigest() if written else "") for n_a, n_b, n_groups, links, written in rows]


def found(df):
    return sorted((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256))
                  for r in df.collect())


@pytest.mark.parametrize("hot", [1_000_000, 20, 0])
def test_alignment_is_that_of_all_tokens(spark, hot):
    docs = table(spark, [(i, t, "a") for i, t in enumerate(TEXTS)])
    want = brute(TEXTS)
    assert found(token_alignment(docs, A, B, hot_pairs=hot)) == sorted(enumerate(want))
    assert any(w[0] == 0 for w in want[5:]) and sum(w[3] for w in want) > 200


def test_alignment_of_the_smallest_table(spark):
    from corpuskit.llm import workload

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").filter("n_chars < 1500")
    kept = rows.orderBy("doc_id").collect()
    assert found(token_alignment(rows, A, B, hot_pairs=500)) == sorted(zip([r.doc_id for r in kept], brute(
        [r.text for r in kept])))
    df = workload.BOOK.queries["op13_token_alignment"](spark, folder)
    assert [c for c, _ in df.dtypes] == [
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for c, t in df.dtypes if c != "groups_sha256"} == {"bigint"}


def test_alignment_takes_awkward_rows(spark):
    rows = token_alignment(awkward(spark), A, B, details=True).collect()
    assert len(rows) == awkward(spark).count()
    by = {r.doc_id: r for r in rows}
    assert by[0].n_a == by[1].n_links == 0 and by[0].groups_sha256 == "" and by[6].n_links > 100_000
    assert all(sum(r.times) == r.n_links for r in rows)
    assert token_alignment(nothing(spark), A, B).count() == 0


def test_byte_ids_are_the_library_s():
    for text in [*TEXTS, LONG[:5000]]:
        want = byte_tokenizer(A).encode(" " + text, add_special_tokens=False).ids
        assert [*memoryview(byte_ids(A, " " + text)).cast("i")] == want
