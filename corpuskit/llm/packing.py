"""Best-fit packing whose bin counts are certified by dual-feasible functions.

Documents are cut into pieces in the map task; from then on only (piece, length)
rows move.  Pieces are dealt at random to parts of a bounded size, packed by best
fit decreasing, and each part's bins are compared with a lower bound.  Parts with
a gap give the pieces of their open bins back; those are dealt anew and repacked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.rows import kept_table, small_batches, whole_text
from corpuskit.llm.tokenizing import word_ids

# Pieces that one part, and so one task, packs.
PART_ROWS = 50_000
ROUNDS = 4


def cut_documents(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text", capacity: int = 2048,
                  end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32) for every document, ``end_id`` appended.

    Null and empty texts give one piece with the end id alone.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = memoryview(word_ids(file, value.as_py()) + end)
                n = len(ids) // 4
                for i, at in enumerate(range(0, n, capacity)):
                    of.append(row)
                    piece.append(i)
                    start.append(at)
                    length.append(min(capacity, n - at))
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + capacity)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key), whole_text(text).alias("_text")).mapInArrow(
        cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; longest first, into the fullest bin that takes it.

    Open bins are kept by the room they have left; a bit mask of the occupied
    rooms finds the smallest one that is large enough.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, used = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fits = mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, bin_, used = capacity, used, used + 1
        bins[at], offsets[at] = bin_, capacity - room
        left = room - size
        if left:
            open_bins[left].append(bin_)
            mask |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs, by two families of dual-feasible functions.

    A function with sum f(x) <= 1 over every set of sizes that fits one bin turns
    the total of f over all items into a lower bound.  The first family sends
    sizes above capacity - t to a full bin and those below t to nothing; the
    second rounds sizes to multiples of capacity / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        full = count[capacity - t + 1:].sum()
        rest = (count[t:capacity - t + 1] * size[t:capacity - t + 1]).sum()
        best = max(best, int(full) - int(-rest // capacity))
    for k in range(1, 33):
        whole = (size * (k + 1)) % capacity == 0
        # k * f(x): exact for whole multiples, else rounded down to one step of k.
        scaled = np.where(whole, size * k, (size * (k + 1)) // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (capacity * k)))
    return best


def _pack_parts(pieces: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    dealt = pieces.select(
        "uid", "length", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)).alias("part"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("uid", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        gap = len(fill) - lower_bound(lengths, capacity)
        return pd.DataFrame({
            "uid": group["uid"], "length": lengths, "part": group["part"], "bin": bins, "offset": offsets,
            "fill": fill[bins], "gap": gap})

    return dealt.groupBy("part").applyInPandas(
        pack, "uid long, length long, part long, bin long, offset long, fill long, gap long"
    ).withColumn("turn", F.lit(turn))


def pack(pieces: DataFrame, capacity: int = 2048, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Full pieces are sequences of their own.  A round replaces the bins it took
    back only if it needs fewer, so more rounds never cost a bin.  Repeated rows
    are packed each for itself.  An empty table gives an empty result.
    """
    pieces = kept_table(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    # Ids of full pieces are negative, of packed ones not.
    whole = pieces.filter(F.col("length") >= capacity).select(
        "uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.filter(F.col("length") < capacity).select("uid", "length")
    loose_rows, settled, last_bins = loose.count(), [], None
    for turn in range(rounds):
        if not loose_rows:
            break
        packed = kept_table(_pack_parts(loose, -(-loose_rows // part_rows), turn, capacity), "packed")
        is_open = (F.col("gap") > 0) & (F.col("fill") < capacity)
        bins = packed.filter(F.col("offset") == 0)
        now, open_now = bins.agg(F.count("*"), F.count_if(is_open)).first()
        if last_bins is not None and now >= last_bins:
            break
        if settled:
            settled[-1] = settled[-1].filter(~is_open)
        settled.append(packed)
        loose, last_bins = packed.filter(is_open).select("uid", "length"), open_now
        loose_rows = loose.count() if open_now > 1 else 0
    sequence = F.col("turn") * 2 ** 58 + F.col("part") * 2 ** 24 + F.col("bin")
    for table in settled:
        whole = whole.unionByName(table.select("uid", sequence.cast("long").alias("sequence_id"), "offset"))
    return pieces.join(whole, "uid").drop("uid")


def best_fit_packing(docs: DataFrame, file: str, key: str = "doc_id", text: str = "text",
                     capacity: int = 2048) -> DataFrame:
    """Every document's pieces with their sequence and their place in it."""
    return pack(cut_documents(docs, file, key, text, capacity), capacity)
