"""Two tokenizers' tokens aligned by the bytes that they cover, with corpus-wide link counts.

Work on tokens is done on flat Arrow arrays of many documents at once: lists are
flattened beside their parent indices, token lengths become document offsets by
cumulative sums within each segment, and an Acero join of (document, end) keys
finds the offsets where both tokenizers end.  Partial counts of linked id pairs
are merged by Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.rows import kept_table, small_batches
from corpuskit.llm.tokenizing import BYTE_PATTERN, PLAIN, Cache

# Characters of text whose tokens are in memory at once; a longer document is taken alone.
CHARS_AT_ONCE = 2_000_000
# Bits of a byte offset in a (document, end) key.
OFFSET_BITS = 40
# Most frequent id pairs whose counts are broadcast: 17 bytes each.
HOT_PAIRS = 1_000_000
# Distinct pairs that a task sums up before it hands them on.
PARTIAL_PAIRS = 2_000_000


@cache
def byte_tokenizer(file: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(file)
    found.encode_special_tokens = True  # their strings are ordinary text
    return found


@cache
def piece_tokenizer(file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file)


@cache
def _byte_codes(file: str) -> Cache:
    return Cache(lambda piece: np.array(
        byte_tokenizer(file).encode(piece, add_special_tokens=False).ids, "<i4").tobytes())


def byte_ids(file: str, text: str) -> bytes:
    """Ids as little-endian 32-bit bytes; texts of plain characters by pre-token, others by the library whole."""
    if PLAIN.fullmatch(text):
        return b"".join(map(_byte_codes(file).__getitem__, BYTE_PATTERN.findall(text)))
    return np.array(byte_tokenizer(file).encode(text, add_special_tokens=False).ids, "<i4").tobytes()


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_vocabulary(file: str) -> pa.Array:
    """The bytes of each id."""
    alphabet, vocabulary = _byte_of_char(), byte_tokenizer(file).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, id_ in vocabulary.items():
        out[id_] = bytes(alphabet[c] for c in entry)
    return pa.array(out, pa.binary())


@cache
def piece_vocabulary(file: str) -> pa.Array:
    """The bytes of each id."""
    model = piece_tokenizer(file)
    return pa.array([
        bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
        for i, piece in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))], pa.binary())


@cache
def _written(size: int) -> pa.Array:
    """Decimal ids with the sign that follows: ``,`` from 0 on, ``|`` from ``size`` on, ``;`` from 2 x ``size`` on."""
    return pa.array([f"{i}{sign}".encode() for sign in ",|;" for i in range(size)], pa.binary())


def _slices(values: pa.Array) -> tuple[memoryview, np.ndarray]:
    """All bytes of a fresh binary array, and where each value starts (the end as the last)."""
    _, offsets, data = values.buffers()
    starts = np.frombuffer(offsets, np.int32, len(values) + 1)
    return memoryview(data if data is not None else b"").cast("B"), starts


def _spelled(ids: pa.ListArray, vocabulary: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Whether each document's tokens spell its text."""
    data, starts = _slices(vocabulary.take(pc.list_flatten(ids)))
    edges = starts[ids.offsets.to_numpy()]
    return np.array([data[a:b] == text for a, b, text in zip(edges[:-1], edges[1:], texts)], dtype=bool)


def _ends(ids: pa.ListArray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, their documents, and (document, end offset) as one ascending key."""
    flat, parents = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(vocabulary.take(flat)), pa.int64())).to_numpy()
    doc = parents.to_numpy().astype(np.int64)
    before = np.r_[np.int64(0), total][ids.offsets.to_numpy()[:-1]]
    return flat.to_numpy(), doc, (doc << OFFSET_BITS) + (total - before[doc])


def align(ids_a: pa.ListArray, ids_b: pa.ListArray, bytes_a: pa.Array, bytes_b: pa.Array) -> dict:
    """Groups and links of documents whose two token lists spell the same bytes.

    Two tokens overlap exactly once between two neighbouring ends of either list,
    so the links are the distinct ends, each with the tokens that cover the bytes
    before it.
    """
    n = len(ids_a)
    a, doc_a, key_a = _ends(ids_a, bytes_a)
    b, doc_b, key_b = _ends(ids_b, bytes_b)
    left = pa.table({"key": key_a, "a": np.arange(len(a))})
    right = pa.table({"key": key_b, "b": np.arange(len(b))})
    both = left.join(right, "key", join_type="inner", use_threads=False)
    end_a, end_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    end_a[both["a"].to_numpy()] = True
    end_b[both["b"].to_numpy()] = True

    # Ends in order, those of b that are no end of a after all of a: two sorted runs to merge.
    order = np.argsort(np.r_[key_a, key_b[~end_b]], kind="stable")
    of_a = order < len(a)
    of_b = ~of_a
    of_b[of_a] = end_a[order[of_a]]
    at_a, at_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    links = pa.table({"doc": doc_a[at_a], "pair": (a[at_a].astype(np.int64) << 32) | b[at_b]})
    pairs = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")

    # The written groups: tokens of a, then of b, group after group.
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    b_starts = np.r_[0, np.flatnonzero(end_b) + 1]
    a_ends = np.flatnonzero(end_a) + 1
    size = max(len(bytes_a), len(bytes_b))
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + b_starts[group_a]] = a + size * end_a
    codes[np.arange(len(b)) + a_ends[group_b]] = b + 2 * size * end_b
    data, starts = _slices(_written(size).take(pa.array(codes)))
    edges = starts[ids_a.offsets.to_numpy().astype(np.int64) + ids_b.offsets.to_numpy()]
    digests = [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(edges[:-1], edges[1:])]
    return {
        "n_a": np.bincount(doc_a, minlength=n), "n_b": np.bincount(doc_b, minlength=n),
        "n_groups": np.bincount(doc_a[end_a], minlength=n), "n_links": np.bincount(doc_a[at_a], minlength=n),
        "groups_sha256": digests,
        "pairs": _listed(pairs["pair"], pairs["doc"].to_numpy(), n),
        "times": _listed(pairs["count_all"].cast(pa.int32()), pairs["doc"].to_numpy(), n)}


def _listed(values: pa.ChunkedArray, doc: np.ndarray, n: int) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=n))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values.combine_chunks())


def _id_lists(texts: list[str], file_a: str, file_b: str) -> tuple[pa.ListArray, pa.ListArray]:
    coded = [byte_ids(file_a, " " + text) if text else b"" for text in texts]
    offsets = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
    ids_a = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
    found = piece_tokenizer(file_b).encode(texts, num_threads=1)
    return ids_a, pa.array([x if text else [] for x, text in zip(found, texts)], pa.list_(pa.int32()))


def aligned_texts(texts: list[str], file_a: str, file_b: str) -> dict:
    """``align`` of texts; those that a tokenizer does not spell have no tokens."""
    bytes_a, bytes_b = byte_vocabulary(file_a), piece_vocabulary(file_b)
    ids_a, ids_b = _id_lists(texts, file_a, file_b)
    wanted = [b" " + text.encode() if text else b"" for text in texts]
    good = _spelled(ids_a, bytes_a, wanted) & _spelled(ids_b, bytes_b, wanted)
    if not good.all():
        texts = [text if ok else "" for text, ok in zip(texts, good)]
        ids_a, ids_b = (
            pa.array([x if ok else [] for x, ok in zip(ids.to_pylist(), good)], pa.list_(pa.int32()))
            for ids in (ids_a, ids_b))
    return align(ids_a, ids_b, bytes_a, bytes_b)


FOUND = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligned(docs: DataFrame, file_a: str, file_b: str, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            start, held = 0, 0
            for at, value in enumerate(texts):
                held += len(value)
                if held >= CHARS_AT_ONCE or at == len(texts) - 1:
                    found = aligned_texts(texts[start:at + 1], file_a, file_b)
                    columns = [batch.column(0).slice(start, at + 1 - start), *[
                        x if isinstance(x, pa.Array) else pa.array(x) for x in found.values()]]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *found])
                    start, held = at + 1, 0

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {FOUND}")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (pair, n) of lists of pairs and times."""
    waiting: list[pa.Table] = []
    rows = 0

    def merged() -> pa.Table:
        return pa.concat_tables(waiting).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(
            ["pair", "n"])

    for batch in batches:
        waiting.append(pa.table({
            "pair": pc.list_flatten(batch.column(0)), "n": pc.list_flatten(batch.column(1)).cast(pa.int64())}))
        rows += len(waiting[-1])
        if rows > PARTIAL_PAIRS:
            waiting = [merged()]
            rows = len(waiting[0])
            if rows > PARTIAL_PAIRS // 2:
                yield from waiting[0].to_batches()
                waiting, rows = [], 0
    if waiting:
        yield from merged().to_batches()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(``pair``, ``n``, ``best``): links of each id pair in the whole table, and whether its b id has no higher."""
    partial = aligned.select("pairs", "times").mapInArrow(_summed, "pair long, n long")
    counts = kept_table(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))
    return kept_table(counts.withColumn("b", b).join(highest, "b").select(
        "pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")


def _least_hot(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach."""
    by_size = dict(counts.groupBy(F.floor(F.log2("n")).alias("size")).count().collect())
    total = 0
    for size in range(max(by_size, default=0), -1, -1):
        total += by_size.get(size, 0)
        if total > most:
            return 2 ** (size + 1)
    return 1


def token_alignment(docs: DataFrame, file_a: str, file_b: str, key: str = "doc_id", text: str = "text",
                    hot_pairs: int = HOT_PAIRS, details: bool = False) -> DataFrame:
    """(key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``) of every row.

    ``file_a`` is a byte-level tokenizer, given a space and the text; ``file_b`` a
    sentencepiece model, which adds the space.  Texts that are null or empty, or
    that one of them does not spell, have zeros.  Counts of at most ``hot_pairs``
    frequent id pairs are broadcast; rarer ones, which no document can crowd, are
    joined.  Repeated rows and null keys are rows like others; columns other than
    the two named are not looked at.  With ``details`` the linked id pairs
    (a * 2^32 + b) and how often a document has them are kept as ``pairs`` and
    ``times``.
    """
    small_batches(docs.sparkSession, "8m")
    # Once written, the row numbers are fixed.
    table = kept_table(_aligned(docs, file_a, file_b, key, text).withColumn(
        "_uid", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(table)
    least = _least_hot(counts, hot_pairs)
    hot = counts.filter(F.col("n") >= least).toArrow().sort_by("pair")
    known = docs.sparkSession.sparkContext.broadcast(
        tuple(hot[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def looked_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, best = known.value
        at = np.searchsorted(keys, pairs)
        at[at == len(keys)] = 0
        found = keys[at] == pairs if len(keys) else np.zeros(len(pairs), dtype=bool)
        return found, n[at] if len(keys) else at, best[at] if len(keys) else found

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = pc.list_parent_indices(batch.column("pairs")).to_numpy()
            times = pc.list_flatten(batch.column("times")).to_numpy().astype(np.int64)
            found, n, best = looked_up(pc.list_flatten(batch.column("pairs")).to_numpy())
            totals = [np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)]
            np.add.at(totals[0], doc[found & best], times[found & best])
            np.add.at(totals[1], doc[found], (times * n)[found])
            out = batch if details else batch.drop_columns(["pairs", "times"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, *map(pa.array, totals)], names=[*out.schema.names, "n_best", "count_sum"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = pc.list_flatten(batch.column("pairs")).to_numpy()
            left = ~looked_up(pairs)[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_uid").take(pc.list_parent_indices(batch.column("pairs"))).filter(pa.array(left)),
                 pa.array(pairs[left]), pc.list_flatten(batch.column("times")).filter(pa.array(left))],
                names=["_uid", "pair", "times"])

    kept = [f for f in table.schema if details or f.name not in ("pairs", "times")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    out = table.mapInArrow(sums, f"{fields}, n_best long, count_sum long")
    if least > 1:
        rows = table.select("_uid", "pairs", "times").mapInArrow(rare, "_uid long, pair long, times int")
        more = rows.join(counts.filter(F.col("n") < least), "pair").groupBy("_uid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
            F.sum(F.col("times") * F.col("n")).alias("_sum"))
        out = out.join(more, "_uid", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))})
    return out.select(
        F.col(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
        *(["pairs", "times"] if details else []))
