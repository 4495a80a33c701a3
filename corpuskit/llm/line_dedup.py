"""Fuzzy line dedup: hash tables, edit similarity, one line of each group.

Lines are normalised, and equal ones fold into one before anything is compared,
so a line that stands in a third of all documents is one row.  Distinct lines
meet in tables, either of sketches (smallest hashes of word pairs, in short
lines of characters) or of permuted SimHash blocks; pairs whose edit similarity
holds are linked, and of each connected group the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.settle import settle
from corpuskit.llm.alignment import within_each
from corpuskit.llm.components import grouped, with_company
from corpuskit.llm.hashing import part_hashes
from corpuskit.llm.order_minhash import _mixed, hash_cache
from corpuskit.llm.rows import counted_hint, kept_table, packed, small_batches, unpacked, whole_text

BITS = 64
# Blank lines stay as they are; all others take part.
FEWEST_WORDS = 1
SIMILAR = 0.9
RADIUS = 3
BLOCKS = 5
# Sketches: tables, and smallest hashes that make one key.
TABLES = 16
KEPT = 3
# Lines of fewer words, or of longer words, are sketched by runs of CHARS characters; from MOST_CHARS_WORDS - 4 words
# on by pairs of words, so that lines on both sides of the border still meet.
MOST_CHARS_WORDS = 12
LONG_WORD = 12
CHARS = 4
# 64-bit words that mark which classes of character pairs a line has an odd number of, and lines marked at once.
MARKS = 8
MARKED_AT_ONCE = 2_000
# Words, or characters, that are hashed at once in a worker.
WORDS_AT_ONCE = 200_000


def normalised(line: str) -> str:
    """Lower case, single blanks."""
    return " ".join(line.lower().split())


def voters(words: list[str]) -> list[str]:
    """The distinct words in order, two at least: a separator or a word that fills a line votes once."""
    distinct = list(dict.fromkeys(words))
    return distinct if len(distinct) > 1 else distinct * 2


def _votes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def simhash(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of consecutive runs of two or more word hashes.

    Words and pairs of neighbours vote; a bit needs more than half of a run's
    votes.  Pairs keep lines apart that share little but one frequent word.
    """
    sizes = np.diff(np.r_[starts, len(words)])
    inside = np.ones(len(words), dtype=bool)
    inside[np.r_[starts[1:], len(words)] - 1] = False
    first = np.flatnonzero(inside)
    pairs = (words[first] * np.uint64(0x9E3779B97F4A7C15)) ^ words[first + 1]
    pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(32)
    votes = _votes(words, starts) + _votes(pairs, starts - np.arange(len(starts)))
    return np.packbits(votes * 2 > (2 * sizes - 1)[:, None], axis=1).view(np.uint64).ravel()


_ODD = np.random.default_rng(20_261_201).integers(1, 2 ** 63, TABLES * KEPT, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _windows(stream: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside the consecutive runs of the stream, and where those of each run start."""
    out = np.zeros(max(0, len(stream) - width + 1), np.uint64)
    for j in range(width):
        out = out * np.uint64(0x100000001B3) + _mixed(stream[j:len(stream) - width + 1 + j] + np.uint64(j))
    inside = np.ones(len(out), dtype=bool)
    for j in range(1, width):
        inside[starts[1:] - j] = False
    return _mixed(out[inside]), starts - (width - 1) * np.arange(len(starts))


def sketches(grams: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A row of TABLES 32-bit keys for each run of grams; a table's key agrees with the chance Jaccard ** KEPT."""
    out = np.empty((len(starts), TABLES), np.uint32)
    for t in range(TABLES):
        value = np.full(len(starts), salt * TABLES + t, np.uint64)
        for odd in _ODD[t * KEPT:(t + 1) * KEPT]:
            value = _mixed(value * np.uint64(0x100000001B3) + np.minimum.reduceat(grams * odd, starts))
        out[:, t] = value >> np.uint64(32)
    return out


def sketch_lines(plain: list[str], least: float = SIMILAR) -> list[np.ndarray]:
    """The keys of normalised lines; none for a line so short that ``least`` allows no edit."""
    found: list[list] = [[] for _ in plain]
    by_words, by_chars, words, chars, word_sizes, char_sizes = [], [], [], [], [], []
    for i, line in enumerate(plain):
        if int((1 - least) * len(line) + 1e-9) < 1:
            continue
        n_words = line.count(" ") + 1
        if n_words >= MOST_CHARS_WORDS - 4:
            by_words.append(i)
            # An empty word before the first and after the last.
            words.append(f" {line} ")
            word_sizes.append(n_words + 2)
        if n_words < MOST_CHARS_WORDS or len(line) > LONG_WORD * n_words:
            by_chars.append(i)
            chars.append(f"\n\n\n{line}\n\n\n")
            char_sizes.append(len(line) + 6)
    if by_words:
        hashes = part_hashes("\n".join(words).encode("utf-8", "surrogatepass"))
        for i, row in zip(by_words, sketches(*_windows(hashes, np.r_[0, np.cumsum(word_sizes)[:-1]], 2), 0)):
            found[i].append(row)
    if by_chars:
        points = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        for i, row in zip(by_chars, sketches(*_windows(points, np.r_[0, np.cumsum(char_sizes)[:-1]], CHARS), 1)):
            found[i].append(row)
    none = np.empty(0, np.int32)
    return [np.concatenate(rows).view(np.int32) if len(rows) > 1 else rows[0].view(np.int32) if rows else none
            for rows in found]


def odd_classes(plain: list[str]) -> np.ndarray:
    """Which of 64 * MARKS classes hold an odd number of a line's pairs of neighbouring characters, as MARKS numbers.

    An edit takes out two pairs and puts in two at most, so it changes four marks at most.
    """
    width = 64 * MARKS
    out = np.empty((len(plain), MARKS), np.int64)
    for low in range(0, len(plain), MARKED_AT_ONCE):
        some = plain[low:low + MARKED_AT_ONCE]
        points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        of = np.repeat(np.arange(len(some)), [len(line) for line in some])
        inside = np.flatnonzero(of[1:] == of[:-1])
        classes = _mixed(points[inside] * np.uint64(0x110000) + points[inside + 1]) % np.uint64(width)
        odd = np.bincount(of[inside] * width + classes.astype(np.int64), minlength=len(some) * width) & 1
        out[low:low + len(some)] = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, MARKS)
    return out


def block_keys(fingerprint: str, radius: int, blocks: int) -> Column:
    """A key for every choice of ``blocks - radius`` blocks; fingerprints within the radius share one."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i: int) -> Column:
        return F.shiftrightunsigned(fingerprint, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    return F.array(*[
        F.xxhash64(F.lit(i), *[block(b) for b in chosen])
        for i, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def _line_table(texts: DataFrame, kind: str, fewest: int, least: float, sketched: bool) -> DataFrame:
    """One row for each line of enough words: place, hash of the normalised line, sketch or fingerprint, length."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = hash_cache()
        places: list[tuple] = []
        digests: list[bytes] = []
        words: list[str] = []
        counts: list[int] = []
        sizes: list[int] = []
        lines: list[str] = []
        waiting = 0

        def flush() -> pd.DataFrame:
            done = pd.DataFrame(places, columns=["key", "version", "line_no"])
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            done["high"], done["low"], done["n_chars"] = halves[:, 0], halves[:, 1], sizes
            if sketched:
                done["print"], done["keys"] = 0, sketch_lines(lines, least)
            else:
                hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                starts = np.r_[0, np.cumsum(counts)[:-1]]
                done["print"], done["keys"] = simhash(hashes, starts).view(np.int64), None
            for held in (places, digests, words, counts, sizes, lines):
                held.clear()
            return done

        for batch in batches:
            for key, version, text in zip(batch["key"], batch["version"], batch["text"]):
                for number, line in enumerate(text.lower().split("\n")):
                    own = line.split()
                    if len(own) < fewest:
                        continue
                    plain = " ".join(own)
                    places.append((key, version, number))
                    digests.append(xxhash.xxh3_128_digest(plain.encode("utf-8", "surrogatepass")))
                    sizes.append(len(plain))
                    if sketched:
                        lines.append(plain)
                        waiting += max(len(own), len(plain) // 5)
                    else:
                        voting = voters(own)
                        words += voting
                        counts.append(len(voting))
                        waiting += len(voting)
                    if waiting >= WORDS_AT_ONCE:
                        yield flush()
                        waiting = 0
        if places:
            yield flush()

    return texts.mapInPandas(
        cut, f"key {kind}, version long, line_no int, high long, low long, n_chars int, print long, keys array<int>")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILAR,
               radius: int | None = RADIUS, blocks: int = BLOCKS, fewest: int = FEWEST_WORDS) -> DataFrame:
    """The rows with repeated lines taken out of their text, ``n_lines`` and ``n_removed`` added.

    Lines of ``fewest`` words or more are the same if they are equal in lower
    case with single blanks, or if their fingerprints differ in at most
    ``radius`` bits and their edit similarity (1 - edits / characters of the
    longer) is ``least`` or more, directly or through others.  With ``radius``
    None fingerprints decide nothing: edit similarity is asked of all lines that
    share a sketch key, which finds nearly all pairs of ``least`` 0.9.  Of a group the
    occurrence with the smallest key, then line number, stays.  Line ends are
    those of ``\\n``.  Null texts stay null and count as empty.  Rows with equal
    key and text count as one document and keep the same lines; rows with a null
    key are left as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    place = F.struct("key", "version", "line_no")
    texts = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("version"), whole_text(text).alias("text"))
    lines = kept_table(_line_table(texts, kind, fewest, least, radius is None), "lines")
    distinct = lines.groupBy("high", "low").agg(
        F.min(place).alias("first"), F.count("*").alias("copies"), F.max("print").alias("print"),
        F.max("n_chars").alias("n_chars"), F.first("keys").alias("keys"))
    # Once written, the numbers are fixed; eight bytes go through the tables instead of a place.
    distinct = kept_table(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    if radius is None:
        # The table's number and its key; half the bytes of long keys, and chance hits are left to edit similarity.
        members = distinct.select("id", F.posexplode("keys").alias("table", "value")).select("id", F.shiftleft(
            (F.col("table") % TABLES).cast("long"), 32).bitwiseOR(
            F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("bucket"))
    else:
        members = distinct.select("id", F.explode(block_keys("print", radius, blocks)).alias("bucket"))

    def compatible(x: str, y: str) -> Column:
        sizes = F.least(f"{x}_n_chars", f"{y}_n_chars") >= least * F.greatest(f"{x}_n_chars", f"{y}_n_chars")
        if radius is None:
            return sizes
        return sizes & (F.bit_count(F.col(f"{x}_print").bitwiseXOR(F.col(f"{y}_print"))) <= radius)

    # Texts are read once, for the lines that share a bucket with another.
    members = kept_table(with_company(members), "buckets")
    wanted = distinct.join(counted_hint(members.select("id").distinct()), "id").select("id", "first.*")

    @F.pandas_udf("string")
    def plain(lines: pd.Series) -> pd.Series:
        return lines.map(normalised)

    shared = kept_table(texts.join(counted_hint(wanted), ["key", "version"]).select(
        "id", F.get(F.split("text", "\n"), F.col("line_no")).alias("line")).dropDuplicates(["id"]).select(
        "id", plain("line").alias("line")), "shared")

    def lines_of(wanted: DataFrame) -> DataFrame:
        """(``id``, normalised ``line``) of the given ids."""
        return shared.join(counted_hint(wanted), "id", "left_semi")

    def marked(open_: DataFrame) -> DataFrame:
        @F.pandas_udf("array<long>")
        def mark(lines: pd.Series) -> pd.Series:
            return pd.Series(list(odd_classes(list(lines))))

        rows = settle(lines_of(kept_table(open_, "open-ids")).select("id", mark("line").alias("marks")), "marks")
        return rows.select("id", *[F.get("marks", F.lit(i)).alias(f"m{i}") for i in range(MARKS)])

    def near(x: str, y: str) -> Column:
        flips = reduce(add, [F.bit_count(F.col(f"{x}_m{i}").bitwiseXOR(F.col(f"{y}_m{i}"))) for i in range(MARKS)])
        return flips <= 4 * F.floor((1 - least) * F.greatest(f"{x}_n_chars", f"{y}_n_chars") + 1e-9)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = kept_table(pairs, "pairs")
        some = kept_table(lines_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "texts")
        both = pairs.join(some.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(
            some.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")

        @F.pandas_udf("boolean")
        def alike(x: pd.Series, y: pd.Series) -> pd.Series:
            # A line stands in many pairs.
            points = {line: np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) for line in set(x) | set(y)}
            left, right = [points[line] for line in x], [points[line] for line in y]
            longest = np.array([max(len(a), len(b)) for a, b in zip(left, right)], np.int64)
            return pd.Series(within_each(left, right, ((1 - least) * longest + 1e-9).astype(np.int64)), dtype=bool)

        return both.filter(alike("line_a", "line_b")).select("a", "b")

    traits = distinct.select("id", "n_chars") if radius is None else distinct.select("id", "print", "n_chars")
    found = grouped(members, traits, compatible, verify, late=(marked, near), central=True)
    # Only lines that stand twice or belong to a group touch the occurrences again.
    groups = distinct.join(found, "id", "left").filter((F.col("copies") > 1) | F.col("component").isNotNull())
    groups = kept_table(groups.select("high", "low", "first", F.coalesce("component", "id").alias("group")), "groups")
    stays = groups.groupBy("group").agg(F.min("first").alias("stays"))
    removed = lines.join(groups.join(stays, "group").select("high", "low", "stays"), ["high", "low"]).filter(
        place != F.col("stays"))
    removed = removed.groupBy("key", "version").agg(F.collect_set("line_no").alias("_removed"))

    df = packed(docs, _text=F.col(text).cast("string"), key=F.col(key), version=F.xxhash64(whole_text(text)))
    df = df.join(removed, ["key", "version"], "left")
    df = settle(df.withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n")), "_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_removed")
    rest = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    df = df.withColumns({
        "_rest": F.when(F.col("_removed").isNull(), F.col("_text")).otherwise(rest),
        "n_lines": F.when(F.coalesce("_text", F.lit("")) == "", 0).otherwise(F.size("_lines")).cast("long"),
        "n_removed": F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed")).cast("long")})
    return unpacked(df, docs, "n_lines", "n_removed", replace={text: "_rest"})
