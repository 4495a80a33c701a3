"""BM25 of many queries in one pass over the corpus, by collection where there are any.

A chunk is one row in one task, so its terms are counted and scored there and
only the best rows of each task move.  Query weights are broadcast behind a
check of their number; ``operators.retrieval`` joins instead where there are more.
Every collection is a corpus of its own: its number of chunks, mean length and
document frequencies.  A corpus without a ``collection`` column is one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions import text as tx
from corpuskit.functions.settle import settle
from corpuskit.operators.running import Running
from corpuskit.session import kept_table

# (query, collection, term) rows whose weights are broadcast: some tens of MB.
BROADCAST_TERMS = 500_000
# Cells of one (queries x chunks) block of scores in a worker.
CELLS = 2_000_000
# The row of a term table that carries a collection's totals; no term is empty.
TOTAL = ""


def collection_of(df: DataFrame) -> Column:
    return F.col("collection").cast("string") if "collection" in df.columns else F.lit("")


def counted(corpus: DataFrame) -> DataFrame:
    """collection, chunk_id, doc_len, terms, tfs: each chunk's distinct terms in order and how often they stand in it.

    Equal terms are neighbours after sorting, so their counts are differences of
    the places where runs start; nothing is shuffled.  A null text has no terms.
    """
    df = corpus.select(
        collection_of(corpus).alias("collection"), "chunk_id",
        F.sort_array(tx.terms(F.coalesce("text", F.lit("")))).alias("_sorted"))
    size = F.size("_sorted")
    fresh = F.filter(
        F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))),
        lambda i: (i < size) & ((i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1))))
    df = settle(settle(df, "_sorted").withColumn("_starts", fresh), "_starts")
    return df.select(
        "collection", "chunk_id", size.alias("doc_len"),
        F.transform("_starts", lambda i: F.get("_sorted", i)).alias("terms"),
        F.transform("_starts", lambda i, j: F.coalesce(F.get("_starts", j + 1), size) - i).alias("tfs"))


def counted_among(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """As ``counted``, but only the given terms, few enough to broadcast; all chunks stay, with their whole length."""
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(sorted(terms))
    df = corpus.select(collection_of(corpus).alias("collection"), "chunk_id",
                       tx.terms(F.coalesce("text", F.lit(""))).alias("words"))
    schema = T.StructType([
        df.schema["collection"], df.schema["chunk_id"], T.StructField("doc_len", T.IntegerType()),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, pa.string())
        width = max(1, len(known))
        for batch in batches:
            words = batch.column("words")
            code = pc.index_in(pc.list_flatten(words), value_set=known)
            hit = pc.is_valid(code).to_numpy(zero_copy_only=False)
            doc = pc.list_parent_indices(words).to_numpy()[hit].astype(np.int64)
            cells, tfs = np.unique(doc * width + code.drop_null().to_numpy(), return_counts=True)
            starts = pa.array(np.searchsorted(cells, np.arange(batch.num_rows + 1) * width), pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("collection"), batch.column("chunk_id"), pc.list_value_length(words).cast(pa.int32()),
                pa.ListArray.from_arrays(starts, known.take(pa.array(cells % width))),
                pa.ListArray.from_arrays(starts, pa.array(tfs, pa.int32()))], names=schema.names)

    return df.mapInArrow(run, schema)


def term_totals(counts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """collection, term, n, length: chunks that have a term; in the row ``TOTAL`` all chunks and their words.

    ``wanted`` (collection, term; few enough to broadcast) leaves other terms out.
    """
    rows = counts.select("collection", "doc_len", F.explode(F.concat(F.array(F.lit(TOTAL)), "terms")).alias("term"))
    if wanted is not None:
        marks = wanted.select("collection").distinct().withColumn("term", F.lit(TOTAL))
        rows = rows.join(F.broadcast(wanted.select("collection", "term").union(marks)), ["collection", "term"], "left_semi")
    return rows.groupBy("collection", "term").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("term") == TOTAL, F.col("doc_len"))).alias("length"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id, collection, term: distinct terms of each query for each of its collections."""
    named = F.explode(F.array_distinct(F.transform("collections", lambda c: c.cast("string")))) \
        if "collections" in queries.columns else F.lit("")
    rows = queries.select("query_id", "text", named.alias("collection"))
    return rows.select("query_id", "collection", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term"))


def inverse_frequency(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)


def saturation(tf: Column, doc_len: Column, avg_len: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))


@dataclass
class Weights:
    """Query terms of one collection: for each term the queries that ask it; queries are numbered in ``names``."""

    avg_len: float
    n_docs: int
    names: list = field(default_factory=list)
    rows: dict = field(default_factory=dict)
    starts: np.ndarray | None = None
    queries: np.ndarray | None = None
    idf: np.ndarray | None = None


def weights(
    queries: DataFrame, corpus: DataFrame, most: int = BROADCAST_TERMS,
) -> tuple[dict[str, Weights], DataFrame] | None:
    """The queries' weights by collection and the counts of their terms in the corpus, or None if there are more than ``most``.

    Texts are read once: what they hold of the queries' terms is stored, for the weights and for ``scan``.
    """
    asked = asked_terms(queries)
    table = asked.limit(most + 1).toArrow()
    if len(table) > most:
        return None
    wanted = corpus.sparkSession.createDataFrame(
        table.select(["collection", "term"]).group_by(["collection", "term"]).aggregate([]))
    frequency: dict = defaultdict(dict)
    out: dict[str, Weights] = {}
    counts = kept_table(counted_among(corpus, pc.unique(table.column("term")).to_pylist()), "query-terms")
    totals = term_totals(counts, wanted).toArrow().to_pydict()
    for name, term, n, length in zip(*(totals[c] for c in ("collection", "term", "n", "length"))):
        if term == TOTAL:
            out[name] = Weights(length / n, n)
        else:
            frequency[name][term] = n
    by_term: dict = defaultdict(lambda: defaultdict(list))
    numbers: dict = defaultdict(dict)
    for query, name, term in zip(*(table.column(c).to_pylist() for c in ("query_id", "collection", "term"))):
        if name in out:
            key = tuple(query.items()) if isinstance(query, dict) else query
            if key not in numbers[name]:
                numbers[name][key] = len(out[name].names)
                out[name].names.append(query)
            if term in frequency[name]:
                by_term[name][term].append(numbers[name][key])
    for name, own in out.items():
        groups = list(by_term[name].items())
        own.rows = {term: at for at, (term, _) in enumerate(groups)}
        own.starts = np.r_[0, np.cumsum([len(q) for _, q in groups])].astype(np.int64)
        own.queries = np.array([q for _, qs in groups for q in qs], np.int64)
        df = np.array([frequency[name][term] for term, _ in groups], np.float64)
        own.idf = np.log((own.n_docs - df + 0.5) / (df + 0.5) + 1.0)
    return out, counts


class _Scan:
    """The best rows, the wanted rows and the range of all scores of one collection's queries in one task.

    With ``k`` None every score is found.
    """

    def __init__(self, own: Weights, k: int | None, k1: float, b: float, wanted: dict) -> None:
        self.own, self.k1, self.b, self.wanted = own, k1, b, wanted
        self.best = Running(len(own.names), k) if k is not None else None
        self.low = np.full(len(own.names), np.inf)
        self.high = np.full(len(own.names), -np.inf)
        self.matched = np.zeros(len(own.names), np.int64)
        self.found: list[tuple] = []

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray,
            terms: list[str]) -> None:
        """Chunks with their places: document number, term code and count; the documents ascend."""
        own, width = self.own, len(self.own.names)
        row = np.array([own.rows.get(t, -1) for t in terms], np.int64)[code]
        hit = row >= 0
        doc, row, tf = doc[hit], row[hit], tf[hit].astype(np.float64)
        part = own.idf[row] * tf * (self.k1 + 1) / (
            tf + self.k1 * (1 - self.b + self.b * lengths[doc] / own.avg_len))
        asking = own.starts[row + 1] - own.starts[row]
        step = max(1, CELLS // max(1, width))
        for low in range(0, len(ids), step):
            x, y = np.searchsorted(doc, [low, low + step])
            times, n = asking[x:y], min(step, len(ids) - low)
            # The asking queries of each place, one after the other.
            at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(own.starts[row[x:y]], times)
            cells = own.queries[at] * n + np.repeat(doc[x:y] - low, times)
            scores = np.bincount(cells, np.repeat(part[x:y], times), minlength=width * n).astype(
                np.float64, copy=False).reshape(width, n)
            some = scores > 0
            if self.best is None:
                query, column = np.nonzero(some)
                self.found += [(query, ids[low + column], scores[query, column])]
                continue
            self.matched += some.sum(axis=1)
            self.high = np.maximum(self.high, scores.max(axis=1, initial=-np.inf, where=some))
            self.low = np.minimum(self.low, scores.min(axis=1, initial=np.inf, where=some))
            for column in range(n) if self.wanted else ():
                for query in self.wanted.get(ids[low + column], ()):
                    if scores[query, column] > 0:
                        self.found.append((query, ids[low + column], scores[query, column]))
            self.best.add(np.where(some, scores, -np.inf), ids[low:low + n])

    def rows(self) -> Iterator[tuple]:
        """(query number, chunk_id, score, low, n); a row without chunk_id has a query's range."""
        for query, id_, score in zip(*self.best.rows()):
            yield query, id_, score, None, None
        for query, id_, score in self.found:
            yield query, id_, score, None, None
        for query in np.flatnonzero(self.matched):
            yield query, None, self.high[query], self.low[query], self.matched[query]


def scan(counts: DataFrame, asked: dict[str, Weights], query_type: T.DataType, k: int | None, k1: float = 1.2,
         b: float = 0.75, wanted: dict[str, dict] | None = None) -> DataFrame:
    """query_id, collection, chunk_id, score, low, n from every task of the corpus, given as ``weights`` counted it.

    Rows with a ``chunk_id`` are the task's ``k`` best of a query and the
    ``wanted`` ones (collection to chunk_id to query numbers); those without have
    the task's highest (``score``) and lowest score of a query and the number of
    chunks that match it.  With ``k`` None there is a row for every matching
    (query, chunk) and none without; it is handed on batch by batch.
    """
    spark = counts.sparkSession
    shared = spark.sparkContext.broadcast((asked, wanted or {}))
    id_type = counts.schema["chunk_id"].dataType
    schema = T.StructType([
        T.StructField("query_id", query_type), T.StructField("collection", T.StringType()),
        T.StructField("chunk_id", id_type), T.StructField("score", T.DoubleType()),
        T.StructField("low", T.DoubleType()), T.StructField("n", T.LongType())])
    arrow = pa.schema([(f.name, t.type) for f, t in zip(schema, spark.createDataFrame([], schema).toArrow().schema)])

    def put(into: _Scan, own: pa.RecordBatch) -> None:
        terms = pc.list_flatten(own.column("terms")).dictionary_encode()
        into.add(
            np.array([*own.column("chunk_id").to_pylist(), None], dtype=object)[:-1],
            own.column("doc_len").to_numpy().astype(np.float64),
            pc.list_parent_indices(own.column("terms")).to_numpy().astype(np.int64),
            terms.indices.to_numpy(), pc.list_flatten(own.column("tfs")).to_numpy(),
            terms.dictionary.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, wanted = shared.value
        scans: dict[str, _Scan] = {}
        for batch in batches:
            names = batch.column("collection").dictionary_encode()
            of = names.indices.fill_null(-1).to_numpy()
            for number, name in enumerate(names.dictionary.to_pylist()):
                if name not in asked:
                    continue
                own = batch if (of == number).all() else batch.filter(pa.array(of == number))
                if name not in scans:
                    scans[name] = _Scan(asked[name], k, k1, b, wanted.get(name, {}))
                if k is not None:
                    put(scans[name], own)
                    continue
                asking = np.array([*asked[name].names, None], dtype=object)[:-1]
                lot = max(1, CELLS // max(1, len(asking)))
                for first in range(0, own.num_rows, lot):
                    put(scans[name], own.take(pa.array(range(first, min(first + lot, own.num_rows)))))
                    for query, ids, scores in scans[name].found:
                        cols = {"query_id": asking[query], "collection": [name] * len(query), "chunk_id": ids, "score": scores}
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cols.get(f.name, [None] * len(query)), type=f.type) for f in arrow], schema=arrow)
                    scans[name].found = []
        for name, found in scans.items() if k is not None else ():
            rows = [(asked[name].names[q], name, *rest) for q, *rest in found.rows()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return counts.mapInArrow(run, schema)
