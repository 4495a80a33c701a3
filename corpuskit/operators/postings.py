"""A stored inverted index by collection, in blocks whose best score is known before they are read.

A collection's chunks are cut into cells of at most a fixed size where they are read.  A block
holds the postings of one term in one cell, beside its largest term frequency and
its smallest length; these bound the score of anything in the block for any
weights.  A search first adds up the bounds of a query's terms cell by cell,
reading no postings, then scores the most promising cells, and from the others
only those whose bound reaches the k-th score found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions import text as tx
from corpuskit.operators import sparse as sp
from corpuskit.operators.ordered import top_rows
from corpuskit.operators.running import TIE_DIGITS
from corpuskit.session import bound_batches, fresh_path, kept_table

BUCKETS = 64
CELL_CHUNKS = 1024
# Words that a task holds before it closes its cells, and blocks that it hands on at once.
WORDS_AT_ONCE = 4_000_000
BLOCKS_AT_ONCE = 20_000
# Cells that a search scores before it knows a k-th score.
FIRST_CELLS = 2
# Bounds and scores add up the same numbers in another order.
SLACK = 1e-6
BLOCK = ["collection", "term", "segment", "cell"]


@dataclass
class Postings:
    """An index below ``path``: ``blocks`` by hash of (collection, term), ``totals`` by segment."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS
    cell_chunks: int = CELL_CHUNKS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("collection", "term"), F.lit(self.buckets)).cast("int")

    def append(self, corpus: DataFrame) -> None:
        """Add chunks (chunk_id, text [, collection]) as a new segment; what is there is not touched.

        A collection's number of chunks and its words grow by the segment's; they
        and the document frequencies are summed when they are read.  Chunks must
        be new: a repeated one counts twice.
        """
        segment = uuid.uuid4().hex
        # Written once, so that a chunk's cell is fixed.
        path = fresh_path(self.spark, "cells")
        self._cells(corpus).write.option("compression", "zstd").parquet(path)
        rows = self.spark.read.parquet(path)
        blocks = rows.filter(F.col("term").isNotNull()).drop("n", "length").withColumn("bucket", self._bucket())
        # What the postings say themselves is added behind the shuffle.
        blocks = blocks.hint("rebalance", "bucket").withColumns({
            "segment": F.lit(segment), "n": F.size("tfs").cast("long"),
            "max_tf": F.array_max("tfs"), "min_len": F.array_min("lens")})
        blocks.sortWithinPartitions("bucket", "collection", "term").write.mode("append").option("compression", "zstd").partitionBy(
            "bucket").parquet(f"{self.path}/blocks")
        # Last: a segment without totals is not there yet.
        rows.filter(F.col("term").isNull()).groupBy("collection").agg(
            F.sum("n").alias("n_docs"), F.sum("length").alias("length")).withColumn(
            "segment", F.lit(segment)).coalesce(1).write.mode("append").parquet(f"{self.path}/totals")

    def _cells(self, corpus: DataFrame) -> DataFrame:
        """The blocks of each cell, and a row without a term that has the cell's ``n`` chunks and ``length`` in words.

        A task takes chunks until it holds ``WORDS_AT_ONCE`` words and cuts each
        collection's into cells, so a term's postings in a cell are gathered where
        they are read and move as one row.
        """
        size = self.cell_chunks
        bound_batches(self.spark)
        df = corpus.select(sp.collection_of(corpus).alias("collection"), "chunk_id",
                           tx.terms(F.coalesce("text", F.lit(""))).alias("words"))
        chunk = df.schema["chunk_id"].dataType
        schema = T.StructType([
            df.schema["collection"], T.StructField("term", T.StringType()), T.StructField("cell", T.LongType()),
            T.StructField("n", T.LongType()), T.StructField("length", T.LongType()),
            T.StructField("chunk_ids", T.ArrayType(chunk)), T.StructField("tfs", T.ArrayType(T.IntegerType())),
            T.StructField("lens", T.ArrayType(T.IntegerType()))])

        def cut(held: list[pa.RecordBatch], first: int) -> tuple[list[pa.RecordBatch], int]:
            table = pa.Table.from_batches(held).combine_chunks()
            names = table["collection"].chunk(0).dictionary_encode(null_encoding="encode")
            ids, words = table["chunk_id"].chunk(0), table["words"].chunk(0)
            codes = names.indices.to_numpy().astype(np.int64)
            lens = pc.list_value_length(words).to_numpy().astype(np.int64)
            # Chunks side by side by collection, cut into cells.
            order = np.argsort(codes, kind="stable")
            ordered = codes[order]
            place = np.arange(len(order)) - np.searchsorted(ordered, ordered)
            starts = np.flatnonzero(place % size == 0)
            number = np.cumsum(place % size == 0) - 1
            cell_of, at = np.empty_like(number), np.empty_like(place)
            cell_of[order], at[order] = number, place % size
            cell_names = names.dictionary.take(pa.array(ordered[starts]))
            cells = pa.array(first + np.arange(len(starts)))
            out = [pa.RecordBatch.from_arrays([
                cell_names, pa.nulls(len(starts), pa.string()), cells, pa.array(np.diff(np.r_[starts, len(order)])),
                pa.array(np.add.reduceat(lens[order], starts)),
                pa.nulls(len(starts), pa.list_(ids.type)), pa.nulls(len(starts), pa.list_(pa.int32())),
                pa.nulls(len(starts), pa.list_(pa.int32()))], names=schema.names)]
            terms = pc.list_flatten(words).dictionary_encode()
            width = max(1, len(terms.dictionary))
            of = pc.list_parent_indices(words).to_numpy()
            found, tfs = np.unique(
                (cell_of[of] * width + terms.indices.to_numpy()) * size + at[of], return_counts=True)
            blocks, place = np.divmod(found, size)
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else np.empty(0, np.int64)
            cell, term = np.divmod(blocks[edges], width)
            chunks = order[starts[blocks // width] + place]
            edges = np.r_[edges, len(found)]
            for low in range(0, len(cell), BLOCKS_AT_ONCE):
                some = slice(low, min(low + BLOCKS_AT_ONCE, len(cell)))
                begin, end = int(edges[some.start]), int(edges[some.stop])
                inner = edges[some.start:some.stop] - begin
                offsets = pa.array(np.r_[inner, end - begin], pa.int32())
                own, tf = chunks[begin:end], tfs[begin:end]
                out.append(pa.RecordBatch.from_arrays([
                    cell_names.take(pa.array(cell[some])), terms.dictionary.take(pa.array(term[some])),
                    pa.array(first + cell[some]), pa.nulls(len(inner), pa.int64()),
                    pa.nulls(len(inner), pa.int64()),
                    pa.ListArray.from_arrays(offsets, ids.take(pa.array(own))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(lens[own], pa.int32()))], names=schema.names))
            return out, first + len(starts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # Numbers that no other task gives.
            first = TaskContext.get().partitionId() << 33
            held, waiting = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    waiting += len(batch.column("words").flatten())
                if waiting >= WORDS_AT_ONCE:
                    out, first = cut(held, first)
                    held, waiting = [], 0
                    yield from out
            if held:
                yield from cut(held, first)[0]

        return df.mapInArrow(run, schema)

    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")

    def blocks(self) -> DataFrame:
        """Blocks of the segments whose totals were written."""
        done = F.broadcast(self.totals().select("segment").distinct())
        return self.spark.read.parquet(f"{self.path}/blocks").join(done, "segment", "left_semi")

    def stats(self) -> DataFrame:
        """collection, n_docs, avg_len over all segments."""
        return self.totals().groupBy("collection").agg(
            F.sum("n_docs").alias("n_docs"), (F.sum("length") / F.sum("n_docs")).alias("avg_len"))

    def document_frequency(self) -> DataFrame:
        """collection, term, df; postings are not read."""
        return self.blocks().groupBy("collection", "term").agg(F.sum("n").alias("df"))

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Headers of the blocks of the queries' terms, and weights by query, collection and term."""
        asked = sp.asked_terms(queries)
        few = asked.limit(sp.BROADCAST_TERMS + 1).count() <= sp.BROADCAST_TERMS
        terms = asked.select("collection", "term").distinct().withColumn("bucket", self._bucket())
        headers = self.blocks().select("bucket", *BLOCK, "n", "max_tf", "min_len")
        headers = kept_table(headers.join(
            F.broadcast(terms) if few else terms, ["bucket", "collection", "term"], "left_semi"), "headers")
        df = headers.groupBy("collection", "term").agg(F.sum("n").alias("df"))
        weighted = asked.join(df, ["collection", "term"]).join(self.stats(), "collection").select(
            "query_id", "collection", "term", "avg_len",
            sp.inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf"))
        return headers, kept_table(weighted, "weights")

    def bounds(self, headers: DataFrame, weighted: DataFrame, k1: float, b: float) -> DataFrame:
        """query_id, collection, segment, cell, bound: no chunk of the cell scores higher."""
        best = F.col("idf") * sp.saturation(F.col("max_tf"), F.col("min_len"), F.col("avg_len"), k1, b)
        return headers.join(weighted, ["collection", "term"]).groupBy(
            "query_id", "collection", "segment", "cell").agg(F.sum(best).alias("bound"))

    def _scores(self, cells: DataFrame, weighted: DataFrame, k1: float, b: float) -> DataFrame:
        """Exact scores of the chunks in (query, cell) rows."""
        wanted = cells.join(weighted, ["query_id", "collection"]).withColumn("bucket", self._bucket())
        # Few blocks are of terms that are asked for; the others stay where they lie.
        terms = weighted.select("collection", "term").distinct().withColumn("bucket", self._bucket())
        few = terms.limit(sp.BROADCAST_TERMS + 1).count() <= sp.BROADCAST_TERMS
        blocks = self.blocks().join(F.broadcast(terms) if few else terms, ["bucket", "collection", "term"], "left_semi")
        found = blocks.join(wanted, ["bucket", *BLOCK]).select(
            "query_id", "collection", "idf", "avg_len", F.explode(F.arrays_zip("chunk_ids", "tfs", "lens")).alias("_p"))
        part = F.col("idf") * sp.saturation(F.col("_p.tfs"), F.col("_p.lens"), F.col("avg_len"), k1, b)
        return found.groupBy("query_id", "collection", F.col("_p.chunk_ids").alias("chunk_id")).agg(
            F.sum(part).alias("score"))

    def plan(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75,
             first_cells: int = FIRST_CELLS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Scores of the first cells, the cells that can still matter, those that cannot, and the weights."""
        headers, weighted = self._asked(queries)
        keys = ["query_id", "collection"]
        bounds = kept_table(self.bounds(headers, weighted, k1, b), "bounds")
        ranked = top_rows(bounds, keys, [F.desc("bound"), F.col("segment"), F.col("cell")], first_cells, "_r")
        first = kept_table(ranked.drop("_r", "bound"), "first-cells")
        scored = kept_table(self._scores(first, weighted, k1, b), "first-scores")
        reached = top_rows(scored, keys, [F.desc("score")], k, "_r").groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
        rest = bounds.join(first, [*keys, "segment", "cell"], "left_anti").join(
            reached.filter(F.col("_n") == k).drop("_n"), keys, "left").withColumn(
            "_open", F.col("_least").isNull() | (F.col("bound") + SLACK >= F.col("_least")))
        rest = kept_table(rest.select(*keys, "segment", "cell", "_open"), "rest")
        return scored, rest.filter("_open").drop("_open"), rest.filter("NOT _open").drop("_open"), weighted

    def topk(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75,
             first_cells: int = FIRST_CELLS) -> DataFrame:
        """query_id, collection, chunk_id, score, rank: the k best of each query in each of its ``collections``.

        Exact: the same rows as scoring every posting.
        """
        scored, open_, _, weighted = self.plan(queries, k, k1, b, first_cells)
        both = scored.unionByName(self._scores(open_, weighted, k1, b))
        order = [F.round("score", TIE_DIGITS).desc(), F.col("chunk_id").asc()]
        return top_rows(both, ["query_id", "collection"], order, k)
