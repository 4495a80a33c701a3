"""SimHash fingerprints of 128 bits and a search by permuted block tables.

Native functions only.  Words vote as rows of an aggregation that combines
map-side: the words of a text stand together, so one row per text is shuffled.
Each vote is two 64-bit words of masked bits; 32-bit lanes add up four of the
128 counters in every pair of sums.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.rows import kept_table, whole_text

BITS = 128
LANES = 0x0000000100000001

# Rows of one block of the order by key; blocks are windows, each in one task.
BLOCK_KEYS = 256
BLOCKS_TOGETHER = 4096


def word_weight(word: Column) -> Column:
    """1 to 7 by length: long words are rarer than short ones in any language."""
    return F.greatest(F.lit(1), F.least(F.char_length(word), F.lit(10)) - 3).cast("long")


def votes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per ``keys`` the signed votes as ``hi`` and ``lo`` of the fingerprint.

    A bit is set where the words whose hash has it outweigh those whose hash has
    not; a tie, and a text without words, leaves it unset.  Rows with equal keys
    vote together.
    """
    words = texts.select(*keys, F.explode_outer(F.split(text, r"[\x20\x09-\x0D]+")).alias("_word"))
    weight = F.when(F.col("_word") != "", word_weight(F.col("_word"))).otherwise(0).cast("long")
    words = words.select(
        *keys, weight.alias("_weight"), F.xxhash64("_word").alias("_h0"),
        F.xxhash64("_word", F.lit(1)).alias("_h1"))
    sums = [
        F.sum(F.shiftrightunsigned(f"_h{half}", i).bitwiseAND(F.lit(LANES)) * F.col("_weight")).alias(f"_s{half}_{i}")
        for half in (0, 1) for i in range(32)]
    summed = words.groupBy(*keys).agg(F.sum("_weight").alias("_total"), *sums)

    def half(which: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            for lane in (0, 1):
                count = F.shiftrightunsigned(f"_s{which}_{i}", 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
                bit = 1 << (32 * lane + i)
                bit = bit - (1 << 64) if bit >= 1 << 63 else bit
                out = out.bitwiseOR(F.when(count * 2 > F.col("_total"), F.lit(bit)).otherwise(0).cast("long"))
        return out

    return summed.select(*keys, half(0).alias("hi"), half(1).alias("lo"))


def hex_fingerprint(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def likeness(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Share of equal bits."""
    return 1.0 - distance(a_hi, a_lo, b_hi, b_lo) / F.lit(float(BITS))


def _blocks(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of the blocks, as even as can be, none across the two halves."""
    half, out = blocks // 2, []
    for side in range(2):
        for i in range(half):
            first, end = bits // 2 * i // half, bits // 2 * (i + 1) // half
            out.append((bits // 2 * side + first, end - first))
    return out


def block_keys(hi: str, lo: str, radius: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - radius`` blocks: the permuted tables.

    Two fingerprints within ``radius`` bits agree in at least so many blocks, so
    they share a key.
    """
    def block(k: int) -> Column:
        first, width = _blocks(BITS, blocks)[k]
        side = hi if first < BITS // 2 else lo
        return F.shiftrightunsigned(side, first % (BITS // 2)).bitwiseAND(F.lit((1 << width) - 1))

    return F.array(*[
        F.xxhash64(F.lit(i), *[block(k) for k in chosen])
        for i, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def within_radius(queries: DataFrame, table: DataFrame, radius: int = 6, blocks: int = 8) -> DataFrame:
    """Pairs (query fingerprint, table fingerprint, distance) within ``radius`` bits.

    Both sides are reduced to distinct fingerprints (``fp_hi``, ``fp_lo``) before
    they meet, so a group of copies is one row.  With eight blocks and radius six
    a key has 32 bits and there are 28 tables; for more rows take more blocks.
    The tables are sorted and merged: Spark sizes an exploded side by the rows
    before it, and would broadcast 28 times what it takes for small.
    """
    def tables(df: DataFrame, side: str) -> DataFrame:
        one = df.select(F.col("fp_hi").alias(f"{side}_hi"), F.col("fp_lo").alias(f"{side}_lo")).distinct()
        return one.withColumn("_key", F.explode(block_keys(f"{side}_hi", f"{side}_lo", radius, blocks)))

    apart = distance(F.col("q_hi"), F.col("q_lo"), F.col("t_hi"), F.col("t_lo"))
    q, t = tables(queries, "q"), tables(table, "t")
    near = q.join(t.hint("merge"), (q["_key"] == t["_key"]) & (apart <= radius))
    return near.select("q_hi", "q_lo", "t_hi", "t_lo", apart.alias("distance")).distinct()


def block_below(blocks: DataFrame) -> DataFrame:
    """Every ``_block`` in use with the next lower one in use, ``_below``; the lowest has the highest.

    Blocks are ordered within stretches of so many numbers, and the stretches by
    one narrow row each: about one for a million keys.
    """
    names = blocks.distinct().withColumn("_stretch", F.floor(F.col("_block") / BLOCKS_TOGETHER))
    stretches = names.groupBy("_stretch").agg(F.max("_block").alias("_top"))
    highest = stretches.agg(F.max("_top")).first()[0]
    before = stretches.select("_stretch", F.lag("_top").over(Window.orderBy("_stretch")).alias("_before"))
    inside = F.lag("_block").over(Window.partitionBy("_stretch").orderBy("_block"))
    return names.withColumn("_inside", inside).join(before, "_stretch").select(
        "_block", F.coalesce("_inside", "_before", F.lit(highest)).alias("_below"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Each row beside the next one by descending key; after the last, the first.

    Columns: key, text, ``_block``, ``_at`` (place in the block, from 1), and
    ``_next_block``, ``_next_at``, ``_next_text``.  Rows are dealt to blocks of
    the key's value; of each block only its upper end moves on to the block
    above.  Equal keys stand by a hash of the text, null keys are a block of
    their own below all others.
    """
    block = F.coalesce(F.floor(F.col(key) / BLOCK_KEYS).cast("long"), F.lit(-(1 << 62)))
    df = docs.select(F.col(key), whole_text(text).alias("_text"))
    df = df.withColumns({"_block": block, "_tie": F.xxhash64("_text")})
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, "_block")
    order = Window.partitionBy("_block").orderBy(F.col(key).asc_nulls_first(), "_tie")
    placed = df.withColumns({
        "_at": F.row_number().over(order), "_before": F.lag("_text").over(order)})
    ends = df.groupBy("_block").agg(
        F.max_by("_text", F.struct(key, "_tie")).alias("_end_text"), F.count("*").alias("_end_at"))
    links = block_below(docs.select(block.alias("_block")))
    links = links.join(ends.withColumnRenamed("_block", "_below"), "_below")
    joined = placed.join(links, "_block", "left")
    at_start = F.col("_at") == 1
    return joined.select(
        key, "_text", "_block", "_at",
        F.when(at_start, F.col("_below")).otherwise(F.col("_block")).alias("_next_block"),
        F.when(at_start, F.col("_end_at")).otherwise(F.col("_at") - 1).cast("long").alias("_next_at"),
        F.when(at_start, F.col("_end_text")).otherwise(F.col("_before")).alias("_next_text"))


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 6,
                          blocks: int = 8, every: int = 20) -> DataFrame:
    """Fingerprints of the texts and their edited texts, likeness, and neighbours.

    The edited text has its last floor(n/2) code points replaced by as many (or
    all) from the start of the next document.  ``n_near`` counts the rows other
    than the row itself whose fingerprint lies within ``radius`` bits; it is
    asked for keys divisible by ``every`` against all rows, and null elsewhere.
    Null texts are empty and have the fingerprint 0.  Equal rows get equal
    fingerprints; each is one row of the result.
    """
    half = F.floor(F.char_length("_text") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("_text"), F.lit(1), F.char_length("_text") - half),
        F.substring(F.col("_next_text"), F.lit(1), half))
    rows = with_next(docs, key, text)
    keys = [key, "_block", "_at", "_next_block", "_next_at", "n_chars", "_sha"]
    rows = rows.select(
        key, "_block", "_at", "_next_block", "_next_at", F.char_length("_text").cast("long").alias("n_chars"),
        F.unhex(F.sha2(edited.cast("binary"), 256)).alias("_sha"),
        F.explode(F.array(
            F.struct(F.lit(0).alias("role"), F.col("_text").alias("text")),
            F.struct(F.lit(1).alias("role"), edited.alias("text")))).alias("_side"))
    rows = rows.select(*keys, F.col("_side.role").alias("_role"), F.col("_side.text").alias("_words"))
    fps = votes(rows, [*keys, "_role"], "_words").groupBy(*keys).agg(*[
        F.max(F.when(F.col("_role") == role, F.col(side))).alias(f"{name}_{side}")
        for role, name in ((0, "fp"), (1, "edited")) for side in ("hi", "lo")])
    fps = kept_table(fps, "fingerprints")
    following = fps.select(
        F.col("_block").alias("_next_block"), F.col("_at").cast("long").alias("_next_at"),
        F.col("fp_hi").alias("next_hi"), F.col("fp_lo").alias("next_lo"))
    # Merged as well: as a file the table is much smaller than its rows in memory.
    out = fps.join(following.hint("merge"), ["_next_block", "_next_at"], "left")

    counts = fps.groupBy("fp_hi", "fp_lo").agg(F.count("*").alias("_rows"))
    near = within_radius(fps.filter(F.col(key) % every == 0), fps, radius, blocks)
    near = near.join(counts, (F.col("t_hi") == F.col("fp_hi")) & (F.col("t_lo") == F.col("fp_lo")))
    near = near.groupBy(F.col("q_hi"), F.col("q_lo")).agg((F.sum("_rows") - 1).alias("_near"))
    out = out.join(near, (F.col("fp_hi") == F.col("q_hi")) & (F.col("fp_lo") == F.col("q_lo")), "left")
    fp = [F.col(c) for c in ("fp_hi", "fp_lo")]
    ed = [F.col(c) for c in ("edited_hi", "edited_lo")]
    nx = [F.col(c) for c in ("next_hi", "next_lo")]
    return out.select(
        key, "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), hex_fingerprint(*fp).alias("fingerprint"),
        hex_fingerprint(*ed).alias("edited_fingerprint"), likeness(*fp, *ed).alias("near_edited"),
        likeness(*fp, *nx).alias("near_next"),
        F.when(F.col(key) % every == 0, F.col("_near")).cast("long").alias("n_near"))
