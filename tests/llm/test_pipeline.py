"""The pipeline against its definition on a small table, worked out stage by stage without Spark."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from corpuskit.llm.tokenizing import encode
from corpuskit.llm.workload import tokenizer_file
from tests.llm.cases import table


def line(name, n=12):
    return " ".join(f"{name}{hashlib.md5(f'{name}{i}'.encode()).hexdigest()[:6]}" for i in range(n)) + "."


def page(name, lines=6):
    return [line(f"{name}{chr(97 + i)}") for i in range(lines)]


LONG = line("long", 100).split()
NEAR = LONG[:40] + line("else", 15).split() + LONG[55:]
TYPO = line("typo", 30)
PAGES = {
    0: page("n"), 1: [*page("m"), page("n")[2]],                   # a line that stands in document 0 already
    2: [" ".join(LONG)], 3: [" ".join(NEAR)],                      # alike as documents, not as lines
    4: [*page("q"), "# $ % & | < >"], 5: ["too short."],           # a line of symbols goes; too few words
    6: [*page("r"), TYPO], 7: [TYPO.replace(TYPO[40], "x", 1), *page("s")],  # one letter differs
    9: page("n"), 10: page("v"), 11: [],                           # a whole copy; nothing at all
}


def kept_texts():
    texts = {i: list(lines) for i, lines in PAGES.items() if i not in (5, 11)}
    texts[4].pop()                          # quality rules
    texts[1].pop(), texts[7].pop(0), texts.pop(9)  # line dedup
    texts.pop(3)                            # near-dedup
    return {i: "\n".join(lines) for i, lines in texts.items()}


def copies(texts, sources):
    size = defaultdict(float)
    for i, text in texts.items():
        size[sources[i]] += len(text)
    scale = sum(size.values()) / sum(math.sqrt(x) for x in size.values())
    out = {}
    for i in texts:
        rate = math.sqrt(size[sources[i]]) * scale / size[sources[i]]
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        k, total = 0, math.exp(-rate)
        while total <= u:
            k += 1
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        out[i] = k
    return out


def test_run_is_the_definition(spark, tmp_path):
    sources = {i: "abc"[i % 3] for i in PAGES}
    rows = [(i, "\n".join(lines) if lines else None, sources[i]) for i, lines in PAGES.items()]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = kept_texts()
    file, want = tokenizer_file("word_bpe_49k.json"), Counter()
    for i, n in copies(texts, sources).items():
        ids = np.array([*encode(file, texts[i]), 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start:start + 2048]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == +want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
