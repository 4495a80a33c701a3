"""Sources mixed to target weights by Poisson replication.

Native functions only.  One small aggregation gives every source its rate; each
document then decides by itself how often it is repeated, so a hot source is
spread over all tasks, and the one shuffle is by a random key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.rows import kept_table, whole_text

# Sources up to this number are joined by broadcast; their table has two numbers each.
BROADCAST_SOURCES = 100_000
HEX_DIGITS = 13


def hashed(seed: str, *columns: Column) -> Column:
    """A whole number below 16^13 from md5, the same in every engine."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("long")


def poisson_count(rate: Column, u: Column) -> Column:
    """The number of k with P(X <= k) <= u for X Poisson distributed: inversion.

    Probabilities are summed from their logarithms, so large rates do not
    underflow.  The sum ends ten deviations and twenty steps above the mean.
    """
    top = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.exp(-rate)
    return F.aggregate(
        F.sequence(F.lit(1), top),
        F.struct((-rate).alias("log"), start.alias("sum"), F.when(start <= u, 1).otherwise(0).alias("n")),
        lambda acc, k: F.struct(
            (acc["log"] + F.log(rate) - F.log(k)).alias("log"),
            (acc["sum"] + F.exp(acc["log"] + F.log(rate) - F.log(k))).alias("sum"),
            (acc["n"] + F.when(acc["sum"] + F.exp(acc["log"] + F.log(rate) - F.log(k)) <= u, 1).otherwise(0))
            .alias("n")),
        lambda acc: acc["n"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source: str = "source", text: str = "text",
                 temper: float = 0.5) -> DataFrame:
    """(source, rate): mean repetitions that bring each source to its share of all characters.

    ``weights`` has columns source and weight; without it a source weighs its
    size to the power ``temper``.  Sources without a weight get the rate 0.  The
    whole keeps its size.  A null source is one of its own, texts count at least
    one character.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")).agg(
        F.sum(F.greatest(F.char_length(whole_text(text)), F.lit(1))).cast("double").alias("_size"))
    sizes = kept_table(sizes, "sizes")
    if weights is None:
        weighed = sizes.withColumn("_weight", F.pow("_size", F.lit(temper)))
    else:
        named = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source")).agg(
            F.sum("weight").cast("double").alias("_weight"))
        weighed = sizes.join(named, "_source", "left").fillna(0.0, ["_weight"])
    all_sizes, all_weights = weighed.agg(F.sum("_size"), F.sum("_weight")).first()
    return weighed.select("_source", (
        F.col("_weight") * (all_sizes / all_weights if all_weights else 0.0) / F.col("_size")).alias("_rate"))


def mix(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", source: str = "source",
        text: str = "text", temper: float = 0.5, seed: str = "mix") -> DataFrame:
    """Each row as many times as its key and source's rate decide, in random order.

    Adds ``copy`` (from 1), ``copies`` and ``mix_key``; rows of a partition stand
    by ``mix_key``, and partitions are dealt by it.  Rows with equal keys have
    equal counts.  Columns of the input that have these names give way.
    """
    spark = docs.sparkSession
    rates = source_rates(docs, weights, source, text, temper)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    kept = [c for c in docs.columns if c not in ("copy", "copies", "mix_key")]
    df = docs.select(
        F.struct(*kept).alias("_row"), F.col(key).alias("_key"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"))
    df = df.join(F.broadcast(rates) if few else rates, "_source")
    u = hashed(seed, F.col("_key")) / F.lit(float(16 ** HEX_DIGITS))
    counted = df.withColumn("copies", F.when(F.col("_rate") > 0, poisson_count(F.col("_rate"), u)).otherwise(0))
    copied = counted.filter(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    copied = copied.withColumn("mix_key", hashed(seed + ":order", F.col("_key"), F.col("copy")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        copied.select("_row.*", F.col("copy").cast("long"), F.col("copies").cast("long"), "mix_key")
        .repartition(n, "mix_key").sortWithinPartitions("mix_key"))
