"""How the sources of a language differ in their terms, by iceberg prefix refinement.

Which terms stand in enough documents is found level by level over prefixes of
their bytes.  A prefix that too few documents have is dropped with everything
that starts with it, so the long tail of rare terms is never counted, grouped or
shuffled as terms.  The prefixes that go on are handed to the next level as a bit
filter of a fixed size; what it lets through by chance is counted like the rest
and then dropped, so the kept terms are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.rows import kept_table, small_batches, whole_text
from corpuskit.session import fresh_path

# What becomes of a byte of UTF-8 text: A-Z lower-cased, letters and bytes beyond ASCII kept, the rest a blank.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
# Ends a complete term; no term holds it.
END = b"\0"
FIRST_LEVEL = 5
# The filter's size as a power of two, and bits set for each prefix.
FILTER_BITS = 24
PROBES = 3
# Partial rows that a task sums up before it hands them on.
PARTIAL_ROWS = 200_000
# Sources whose distances one group of a task holds, and term rows that go to one group.
BLOCK = 512
GROUP_ROWS = 100_000
# Bytes of text whose documents share one bag.
BAG_BYTES = 1_500_000
BAG = ("langs array<string>, sources array<string>, groups binary, terms array<binary>, docs binary, codes binary, "
       "times binary")


def _bag(langs: list[str], sources: list[str], texts: list[bytes]) -> dict:
    """Distinct terms of some documents in order, and for each document in turn which it has, ascending, and how often."""
    numbers: dict[tuple, int] = {}
    groups = [numbers.setdefault(pair, len(numbers)) for pair in zip(langs, sources)]
    flat: list[bytes] = []
    sizes = []
    for text in texts:
        own = text.translate(TERM_BYTES).split()
        flat += own
        sizes.append(len(own))
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    # Documents, and their terms, in order.
    places, times = np.unique(
        np.repeat(np.arange(len(texts)), sizes) * max(1, len(order)) + rank[coded.indices.to_numpy()], return_counts=True)
    docs, codes = np.divmod(places, max(1, len(order)))
    return {
        "langs": [x for x, _ in numbers], "sources": [x for _, x in numbers],
        "groups": np.array(groups, "<i4").tobytes(), "terms": coded.dictionary.take(order), "docs": docs.astype("<i4").tobytes(),
        "codes": codes.astype("<i4").tobytes(), "times": times.astype("<i4").tobytes()}


def term_bags(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Terms of all documents, some documents in one row; kept as a table that every later pass reads."""
    small_batches(docs.sparkSession, "4m")
    kinds = [pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.binary()), *[pa.binary()] * 3]
    names = [field.split()[0] for field in BAG.split(", ")]

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, size = ([], [], []), 0
            for at in range(batch.num_rows):
                row = [batch.column(i)[at].as_py() for i in range(3)]
                size += len(row[2])
                for held, value in zip(waiting, row):
                    held.append(value)
                if size >= BAG_BYTES or at == batch.num_rows - 1:
                    found = _bag(*waiting)
                    terms = pa.ListArray.from_arrays(pa.array([0, len(found["terms"])], pa.int32()), found["terms"])
                    yield pa.RecordBatch.from_arrays(
                        [terms if n == "terms" else pa.array([found[n]], k) for n, k in zip(names, kinds)], names=names)
                    waiting, size = ([], [], []), 0

    rows = docs.select(whole_text(lang), whole_text(source), F.encode(whole_text(text), "UTF-8")).mapInArrow(bags, BAG)
    path = fresh_path(docs.sparkSession, "bags")
    # Rows are large: their number must not decide when a row group is full.
    rows.write.option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "4").option(
        "parquet.block.size", 32 * 2 ** 20).parquet(path)
    return docs.sparkSession.read.parquet(path)


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A row of ``PROBES`` bit numbers for each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(2 ** bits - 1)


def _hashes(langs: list[str], lang_codes: np.ndarray, prefixes: list[bytes], codes: np.ndarray) -> np.ndarray:
    """Hashes of (language, prefix) pairs."""
    heads = [x.encode() + END for x in langs]
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(heads[x] + prefixes[y]) for x, y in zip(lang_codes.tolist(), codes.tolist())),
        np.uint64, len(codes))


def prefix_filter(prefixes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Rows of (``lang``, ``prefix``) as a filter of 2^bits bits; that is all the driver gets, however many there are."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(2 ** bits // 64, np.uint64)
        for batch in batches:
            own = batch.column(0).dictionary_encode()
            hashes = _hashes(own.dictionary.to_pylist(), own.indices.to_numpy(), batch.column(1).to_pylist(),
                             np.arange(batch.num_rows))
            probes = _probes(hashes, bits).ravel()
            np.bitwise_or.at(filled, (probes >> np.uint64(6)).astype(np.int64), np.uint64(1) << (probes & np.uint64(63)))
        at = np.flatnonzero(filled)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(filled[at].view(np.int64))], names=["at", "word"])

    merged = prefixes.select("lang", "prefix").mapInArrow(words, "at long, word long").groupBy("at").agg(
        F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(2 ** bits // 64, np.uint64)
    out[merged["at"].to_numpy()] = merged["word"].to_numpy().view(np.uint64)
    return out


def _passes(filled: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    probes = _probes(hashes, bits)
    return ((filled[(probes >> np.uint64(6)).astype(np.int64)] >> (probes & np.uint64(63))) & np.uint64(1)).all(axis=1)


class _Partial:
    """Sums over some key columns, handed on when there are many."""

    def __init__(self, keys: list[str], value: str) -> None:
        self.keys, self.value = keys, value
        self.waiting: list[pa.Table] = []
        self.rows = 0

    def _merged(self) -> pa.Table:
        return pa.concat_tables(self.waiting).group_by(self.keys, use_threads=False).aggregate(
            [(self.value, "sum")]).rename_columns([*self.keys, self.value])

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.waiting.append(table)
        self.rows += len(table)
        if self.rows > PARTIAL_ROWS:
            self.waiting = [self._merged()]
            self.rows = len(self.waiting[0])
            if self.rows > PARTIAL_ROWS // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            yield from self._merged().to_batches()
        self.waiting, self.rows = [], 0


class _Bag:
    """One bag as numbers: for each place its document, language and term, by document and then by term."""

    def __init__(self, row: dict) -> None:
        self.doc, self.code, self.group = (
            np.frombuffer(row[name], "<i4").astype(np.int64) for name in ("docs", "codes", "groups"))
        self.times = np.frombuffer(row.get("times", b""), "<i4")
        self.group_langs, self.group_sources = row["langs"], row["sources"]
        self.langs = sorted(set(self.group_langs))
        self.lang = np.array([self.langs.index(x) for x in self.group_langs], np.int64)[self.group]
        self.plain = row["terms"]
        self.terms = pc.binary_join_element_wise(row["terms"], pa.scalar(END, pa.binary()), pa.scalar(b"", pa.binary()))

    def passing(self, length: int, filled: np.ndarray, bits: int, longer_than: int = 0) -> np.ndarray:
        """Numbers of the places whose prefix of this length may be one of the filter's.

        Only terms of more bytes than ``longer_than``, their end counted, are looked at.
        """
        places = np.flatnonzero((pc.binary_length(self.terms).to_numpy() > longer_than)[self.code])
        prefixes = pc.binary_slice(self.terms, 0, length).dictionary_encode()
        width = max(1, len(prefixes.dictionary))
        own = self.lang[self.doc[places]] * width + prefixes.indices.to_numpy().astype(np.int64)[self.code[places]]
        pairs, where = _distinct(own, len(self.langs) * width)
        hashes = _hashes(self.langs, pairs // width, prefixes.dictionary.to_pylist(), pairs % width)
        return places[_passes(filled, hashes, bits)[where]]


def _read_bags(batch: pa.RecordBatch) -> Iterator[_Bag]:
    for at in range(batch.num_rows):
        terms = batch.column("terms")[at].values
        if terms is not None and len(terms):
            yield _Bag({name: terms if name == "terms" else batch.column(name)[at].as_py() for name in batch.schema.names})


# Numbers up to this are told apart by a table of all of them instead of by sorting.
MOST_DIRECT = 4_000_000


def _distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them."""
    if below > MOST_DIRECT:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(below, dtype=bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[values]


def _tally(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and how often they stand there."""
    if below > MOST_DIRECT:
        return np.unique(values, return_counts=True)
    n = np.bincount(values, minlength=below)
    found = np.flatnonzero(n)
    return found, n[found]


def _level(bags: DataFrame, length: int, before: int, filled: np.ndarray | None, bits: int) -> DataFrame:
    """(``lang``, ``prefix``, ``docs``) of the prefixes of this length whose own prefix passed the level before."""
    known = bags.sparkSession.sparkContext.broadcast(filled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = _Partial(["lang", "prefix"], "docs")
        for some in (bag for batch in batches for bag in _read_bags(batch)):
            doc, code = some.doc, some.code
            if known.value is not None:
                # Terms that were complete have been decided.
                open_ = some.passing(before, known.value, bits, longer_than=before)
                doc, code = doc[open_], code[open_]
            prefixes = pc.binary_slice(some.terms, 0, length).dictionary_encode()
            width, own = len(prefixes.dictionary), prefixes.indices.to_numpy().astype(np.int64)[code]
            # A document counts once for a prefix; its terms that start so are neighbours.
            fresh = np.ones(len(doc), dtype=bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
            pairs, n = _tally(some.lang[doc[fresh]] * width + own[fresh], len(some.langs) * width)
            yield from partial.add(pa.table({
                "lang": pa.array(some.langs, pa.string()).take(pa.array(pairs // width)),
                "prefix": prefixes.dictionary.take(pa.array(pairs % width)), "docs": n.astype(np.int64)}))
        yield from partial.rest()

    found = bags.drop("times").mapInArrow(count, "lang string, prefix binary, docs long")
    return found.groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))


def frequent_terms(bags: DataFrame, least_docs: int, bits: int = FILTER_BITS) -> DataFrame:
    """(``lang``, ``term``, ``docs``) of the terms in at least ``least_docs`` rows of their language.

    Levels double, so their number grows with the logarithm of the longest
    frequent prefix.
    """
    length, before, filled, done = FIRST_LEVEL, 0, None, None
    complete = F.endswith("prefix", F.lit(END))
    while True:
        level = kept_table(_level(bags, length, before, filled, bits).filter(F.col("docs") >= least_docs), "prefixes")
        whole = level.filter(complete)
        done = whole if done is None else done.unionByName(whole)
        open_ = level.filter(~complete)
        if open_.isEmpty():
            return done.select(
                "lang", F.decode(F.expr("substring(prefix, 1, octet_length(prefix) - 1)"), "UTF-8").alias("term"),
                "docs")
        filled, before, length = prefix_filter(open_, bits), length, 2 * length


def term_counts(bags: DataFrame, kept: DataFrame, least_docs: int, most_sources: int, bits: int = FILTER_BITS) -> DataFrame:
    """(``lang``, ``part``, ``term``, ``sources``, ``times``): one row for each kept term, with the sources that have it.

    Only terms that pass a filter of the kept ones are summed, and what it lets
    through by chance is dropped by its own number of documents.  A part is a
    group of some terms of a language.
    """
    filled = prefix_filter(kept.select("lang", F.concat(F.encode("term", "UTF-8"), F.lit(END)).alias("prefix")), bits)
    known = bags.sparkSession.sparkContext.broadcast(filled)
    spread = max(1, -(-kept.count() * most_sources // GROUP_ROWS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (bag for batch in batches for bag in _read_bags(batch)):
            longest = max(1, pc.max(pc.binary_length(some.terms)).as_py())
            chosen = some.passing(longest, known.value, bits)
            width = len(some.terms)
            pairs, where = _distinct(
                some.group[some.doc[chosen]] * width + some.code[chosen], len(some.group_langs) * width)
            own = pa.array(pairs // width)
            # A bag's sums; those of several bags have few terms and sources in common.
            yield from pa.table({
                "lang": pa.array(some.group_langs, pa.string()).take(own), "term": some.plain.take(pa.array(pairs % width)),
                "source": pa.array(some.group_sources, pa.string()).take(own),
                "n": np.bincount(where, some.times[chosen].astype(np.float64), len(pairs)).astype(np.int64),
                "docs": np.bincount(where, minlength=len(pairs)).astype(np.int64)}).to_batches()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        terms = rows["term"].combine_chunks().dictionary_encode()
        code = terms.indices.to_numpy()
        enough = np.bincount(code, rows["docs"].to_numpy(), len(terms.dictionary)) >= least_docs
        order = np.argsort(code, kind="stable")
        order = order[enough[code[order]]]
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(code[order], minlength=len(enough))[enough])].astype(np.int32))
        take = pa.array(order)
        names = terms.dictionary.filter(pa.array(enough)).cast(pa.string())
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(names), pa.string()),
            "part": pa.array([key[1].as_py()] * len(names), pa.int32()), "term": names,
            "sources": pa.ListArray.from_arrays(offsets, rows["source"].combine_chunks().take(take)),
            "times": pa.ListArray.from_arrays(offsets, rows["n"].combine_chunks().take(take))})

    found = bags.mapInArrow(count, "lang string, term binary, source string, n long, docs long")
    # Summed by Spark first, in the same exchange, so that a group holds each term and source once.
    found = found.withColumn("part", F.pmod(F.hash("term"), F.lit(spread)).cast("int")).repartition("lang", "part")
    found = found.groupBy("lang", "part", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return found.groupBy("lang", "part").applyInArrow(merge, "lang string, part int, term string, sources array<string>, times array<long>")


def divergences(counts: DataFrame, groups: DataFrame, top: int, prior: int, scale: int) -> DataFrame:
    """(``lang``, ``source``, ``part``, ``item``, ``value``), unranked: all pairs, and more terms than are wanted.

    ``counts`` is from ``term_counts``; ``groups`` has ``lang``, ``source``, its
    ``total``, the language's ``lang_total`` and kept ``terms``.  A part's terms
    meet two blocks of the language's sources, so a task holds ``BLOCK`` x
    ``BLOCK`` sums at most; these and each source's ``top`` terms of the part are
    the rows that go on.
    """
    numbered = groups.withColumn("_block", F.floor((F.row_number().over(
        Window.partitionBy("lang").orderBy("source")) - 1) / BLOCK).cast("int"))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    numbered = kept_table(numbered.join(blocks, "lang"), "numbered")
    parts = counts.select("lang", "part").union(
        groups.select("lang", F.lit(0).alias("part"))).distinct()
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda i: F.transform(
        F.sequence(i, F.col("_blocks") - 1), lambda j: F.struct(i.alias("low"), j.alias("high")))))).alias("_cell")
    keys = ["lang", "part", "low", "high"]
    left = counts.join(blocks, "lang").select("lang", "part", "term", "sources", "times", pairs).select(
        "lang", "part", "_cell.*", "term", "sources", "times").toDF(*keys, "term", "sources", "times")
    right = numbered.join(parts, "lang").select("*", pairs).select("*", "_cell.*").filter(
        (F.col("_block") == F.col("low")) | (F.col("_block") == F.col("high")))
    fields = ["_block", "source", "total", "lang_total", "terms"]
    right = right.select(*keys, *fields).toDF(*keys, *fields)

    def share(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
        # Whole numbers of any size where 64 bits might not do.
        wide = scale * (int(n.max(initial=0)) + prior) >= 2 ** 62
        n = n.astype(object) if wide else n
        return (1 + scale * (n + prior) // (total + prior * terms)).astype(np.int64)

    def cell(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        low, high = key[2].as_py(), key[3].as_py()
        own = own.sort_by([("_block", "ascending"), ("source", "ascending")])
        block, total = own["_block"].to_numpy(), own["total"].to_numpy()
        lang_total, terms = own["lang_total"][0].as_py(), own["terms"][0].as_py()
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        names = own["source"].combine_chunks()
        # The share of a term that a source lacks.
        zero = share(np.zeros(len(total), np.int64), total, terms) if terms else np.zeros(len(total), np.int64)
        apart = np.abs(zero[first][:, None] - zero[second][None, :])
        # What terms that neither has add up to is counted in the first part.
        sums = apart * terms if key[1].as_py() == 0 else np.zeros_like(apart)
        out = []
        if len(rows):
            lists = rows["sources"].combine_chunks()
            times = pc.list_flatten(rows["times"].combine_chunks()).to_numpy()
            term = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            at = pc.index_in(pc.list_flatten(lists), names).fill_null(-1).to_numpy()
            whole = np.zeros(len(rows), np.int64)
            np.add.at(whole, term, times)
            here = at >= 0
            term, at, times = term[here], at[here], times[here]
            p = share(times, total[at], terms)
            step = max(1, 2_000_000 // len(own))
            for start in range(0, len(rows), step):
                x, y = np.searchsorted(term, [start, start + step])
                shares = np.repeat(zero[:, None], min(step, len(rows) - start), axis=1)
                shares[at[x:y], term[x:y] - start] = p[x:y]
                for i, source in enumerate(first):
                    sums[i] += np.abs(shares[second] - shares[source]).sum(axis=1)
                sums -= apart * shares.shape[1]
            if low == high:
                gain = p - share(whole, np.int64(lang_total), terms)[term]
                texts = rows["term"].combine_chunks()
                for source in range(len(own)):
                    mine = np.flatnonzero((at == source) & (gain > 0))
                    if len(mine) > top:  # ties at the last place stay for the ranking
                        mine = mine[gain[mine] >= np.partition(gain[mine], -top)[-top]]
                    out.append(pa.table({
                        "source": names.take(pa.array(np.full(len(mine), source))), "part": ["term"] * len(mine),
                        "item": texts.take(pa.array(term[mine])), "value": gain[mine]}, schema=FOUND))
        i, j = np.nonzero(first[:, None] != second[None, :])
        i, j = (i, j) if low != high else (i[first[i] < second[j]], j[first[i] < second[j]])
        out.append(pa.table({
            "source": names.take(pa.array(first[i])), "part": ["pair"] * len(i), "item": names.take(pa.array(second[j])),
            "value": sums[i, j]}, schema=FOUND))
        found = pa.concat_tables(out)
        return found.add_column(0, "lang", pa.array([key[0].as_py()] * len(found), pa.string()))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        cell, "lang string, source string, part string, item string, value long")


FOUND = pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                      least_docs: int = 30, top: int = 50, prior: int = 5, scale: int = 1_000_000_000,
                      bits: int = FILTER_BITS) -> DataFrame:
    """(``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``) for every source of a language.

    Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII;
    those in at least ``least_docs`` rows of the language are kept.  A group's
    share of a term is 1 + floor(``scale`` * (n + ``prior``) / (N + ``prior`` *
    V)), exactly.  Part ``pair`` has the sum of the differences to each other
    source of the language over all kept terms; part ``term`` the ``top`` terms
    whose share is above that in the whole language, by how much.  Ties go by the
    item's bytes.  Nulls count as empty: a null language or source is the one
    named ``''``.  Every row is a document, repeated ones and those without terms
    too; a language without kept terms has pairs of value 0.  Columns other than
    the three named are not looked at, and an empty table gives an empty result.
    """
    bags = term_bags(docs, lang, source, text)
    kept = kept_table(frequent_terms(bags, least_docs, bits), "terms")
    pairs = F.explode(F.arrays_zip("langs", "sources")).alias("g")
    named = kept_table(bags.select(pairs).select(
        F.col("g.langs").alias("lang"), F.col("g.sources").alias("source")).distinct(), "named")
    most = named.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    counts = kept_table(term_counts(bags, kept, least_docs, most, bits), "counts")
    here = counts.select("lang", F.explode(F.arrays_zip("sources", "times")).alias("x")).groupBy(
        "lang", F.col("x.sources").alias("source")).agg(F.sum("x.times").alias("total"))
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = kept_table(named.join(here, ["lang", "source"], "left"), "groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    groups = groups.join(size, "lang", "left").join(whole, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    found = kept_table(divergences(counts, groups, top, prior, scale), "found")
    between = found.filter(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(
        F.sum("value").alias("value"))
    both = F.explode(F.array(*[
        F.struct(F.col(x).alias("source"), "part", F.col(y).alias("item"), "value")
        for x, y in (("source", "item"), ("item", "source"))])).alias("row")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.filter(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= top).unionByName(
        between.select("lang", both).select("lang", "row.*").withColumn("rank", F.row_number().over(order)))
