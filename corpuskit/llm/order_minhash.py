"""Near-duplicates by order MinHash, verified by banded alignment.

Copies with the same words fold into one before anything else.  A sketch keeps,
for each hash function, the few k-mers with the smallest hashes in the order in
which they stand in the text, so texts must share content and its order to
agree.  K-mers carry the number of their earlier equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.alignment import within
from corpuskit.llm.components import grouped
from corpuskit.llm.rows import counted_hint, kept_table, small_batches, whole_text
from corpuskit.llm.tokenizing import Cache
from corpuskit.operators.skew import join_copies

WORDS = 5
SIMILAR = 0.8
# Hash functions, and k-mers kept by each.
SKETCHES = 48
KEPT = 3
# 64-bit words that mark which classes of numbered words a text has an odd number of.
MARKS = 32
# Copies from which on a text or class is dealt out over tasks, and how many such keys there are at most.
HOT_ROWS = 500
HOT_KEYS = 100_000
# Cells of one (functions x k-mers) matrix in a worker.
CELLS = 1_000_000

_ODD = np.random.default_rng(20_240_607).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str, cache: Cache) -> np.ndarray:
    """64-bit hashes of the lower-cased words between white space."""
    words = text.lower().split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def hash_cache() -> Cache:
    return Cache(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def numbered(items: np.ndarray) -> np.ndarray:
    """Hashes of the items, equal ones told apart by their number."""
    order = np.argsort(items, kind="stable")
    ordered = items[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(items)])
    number = np.empty(len(items), np.uint64)
    number[order] = np.arange(len(items)) - np.repeat(starts, np.diff(np.r_[starts, len(items)]))
    return _mixed(items + number * np.uint64(0xD6E8FEB86659FD93))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows, equal ones told apart by their number; a short text is one window."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x100000001B3) + _mixed(words[j:len(words) - k + 1 + j] + np.uint64(j))
    return numbered(out)


def sketch(words: np.ndarray, k: int = WORDS, functions: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """One 64-bit value per hash function: its ``kept`` smallest k-mers, in text order."""
    grams = kmers(words, k)
    if not len(grams):
        return np.empty(0, np.uint64)
    kept = min(kept, len(grams))
    out = np.empty(functions, np.uint64)
    step = max(1, CELLS // len(grams))
    for low in range(0, functions, step):
        odd = _ODD[low:min(low + step, functions), None]
        cells = grams[None, :] * odd
        rows = np.arange(len(cells))
        chosen = np.empty((len(cells), kept), np.int64)
        for j in range(kept):
            chosen[:, j] = cells.argmin(axis=1)
            cells[rows, chosen[:, j]] = np.iinfo(np.uint64).max
        chosen.sort(axis=1)
        value = np.arange(low, low + len(cells), dtype=np.uint64)
        for j in range(kept):
            value = _mixed(value * np.uint64(0x100000001B3) + grams[chosen[:, j]])
        out[low:low + len(cells)] = value
    return out


def presence(words: np.ndarray) -> np.ndarray:
    """Which of 64 * MARKS classes hold an odd number of a text's numbered words.

    An edit changes two marks at most, one that puts in or takes out a word only one.
    """
    classes = ((numbered(words) >> np.uint64(20)) % np.uint64(64 * MARKS)).astype(np.int64)
    odd = (np.bincount(classes, minlength=64 * MARKS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edits / words of the longer reaches ``least``; two empty texts are alike."""
    longest = max(len(a), len(b))
    return within(a, b, int((1 - least) * longest + 1e-9))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR,
                    k: int = WORDS) -> DataFrame:
    """(key, ``class_id``, ``class_size``, ``n_words``): classes of linked texts, one row for each input row.

    Two texts are linked if their words, lower-cased, have an edit similarity of
    ``least`` or more and they share a sketch value; classes are the connected
    groups, named by their smallest key.  Rows with the same words are always in
    one class, null and empty texts form one.  A row with a null key is in no
    class.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = hash_cache()
        for batch in batches:
            rows = []
            for id_, value in zip(batch["id"], batch["text"]):
                words = word_hashes(value, cache)
                whole = xxhash.xxh3_128_intdigest(words.tobytes())
                rows.append((
                    id_, len(words), presence(words), np.uint64(whole >> 64).astype(np.int64),
                    np.uint64(whole & (2 ** 64 - 1)).astype(np.int64), sketch(words, k).view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "n_words", "marks", "high", "low", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("id"), whole_text(text).alias("text"))
    sketched = kept_table(texts.filter(F.col("id").isNotNull()).mapInPandas(
        sketches, f"id {kind}, n_words long, marks array<long>, high long, low long, sketch array<long>"), "sketches")
    # The first id of each text, with its traits; a text with very many copies is dealt out where its copies meet it.
    copies = kept_table(sketched.groupBy("high", "low").agg(
        F.min("id").alias("first"), F.count("*").alias("copies"),
        F.min_by(F.struct("n_words", "marks", "sketch"), "id").alias("_of")), "copies")
    hot_rows = max(HOT_ROWS, sketched.count() // HOT_KEYS)
    firsts = copies.select(F.col("first").alias("id"), "_of.*")
    members = firsts.select("id", F.explode("sketch").alias("bucket"))
    traits = firsts.select("id", "n_words", *[F.get("marks", F.lit(i)).alias(f"m{i}") for i in range(MARKS)])

    def compatible(x: str, y: str) -> Column:
        longest = F.greatest(f"{x}_n_words", f"{y}_n_words")
        edits = F.floor((1 - least) * longest + 1e-9)
        flips = reduce(add, [F.bit_count(F.col(f"{x}_m{i}").bitwiseXOR(F.col(f"{y}_m{i}"))) for i in range(MARKS)])
        # Each word that one has more is an edit that changes one mark.
        more = longest - F.least(f"{x}_n_words", f"{y}_n_words")
        return (more <= edits) & (flips <= 2 * edits - more)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = kept_table(pairs, "pairs")
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        some = texts.join(counted_hint(wanted), "id", "left_semi").dropDuplicates(["id"])
        some = kept_table(some, "texts")
        both = pairs.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(
            some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

        def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cache = hash_cache()
            for batch in batches:
                good = [similar(word_hashes(x, cache), word_hashes(y, cache), least)
                        for x, y in zip(batch["text_a"], batch["text_b"])]
                yield batch.loc[good, ["a", "b"]]

        return both.mapInPandas(align, f"a {kind}, b {kind}")

    found = grouped(members, traits, compatible, verify).select(F.col("id").alias("first"), F.col("component"))
    # Classes and their sizes by text, then by row: what the rows of a text meet is one row.
    texts_in = copies.select("high", "low", "first", "copies").join(found, "first", "left").select(
        "high", "low", "copies", F.coalesce("component", "first").alias("class_id"))
    sizes = texts_in.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count("*").alias("copies"))
    classes = join_copies(texts_in.select("high", "low", "class_id"), sizes.select("class_id", "class_size"),
                          ["class_id"], sizes.select("class_id", "copies"), hot_rows)
    classes = join_copies(sketched.select("id", "n_words", "high", "low"), classes, ["high", "low"],
                          copies.select("high", "low", "copies"), hot_rows)

    @F.pandas_udf("long")
    def count_words(values: pd.Series) -> pd.Series:
        return values.map(lambda value: len(value.lower().split()))

    return classes.select(F.col("id").alias(key), "class_id", "class_size", "n_words").unionByName(
        docs.filter(F.col(key).isNull()).select(
            F.col(key), F.lit(None).cast(kind).alias("class_id"), F.lit(1).cast("long").alias("class_size"),
            count_words(whole_text(text)).alias("n_words")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """The rows whose key names their class, once each; rows with a null key stay."""
    classes = near_duplicates(docs, key, text, least)
    kept = classes.filter(F.col(key) == F.col("class_id")).select(key).distinct()
    return docs.join(kept, key, "left_semi").dropDuplicates([key]).unionByName(docs.filter(F.col(key).isNull()))
