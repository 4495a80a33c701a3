"""Connected components, and candidate pairs from shared buckets without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.rows import kept_alone, kept_table


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``component``): the smallest id linked to it, for all ids in ``a`` or ``b``.

    Alternates two steps until nothing changes: every node hands its smallest
    neighbour to its larger ones, then to its smaller ones.  Each round is two
    aggregations and two joins over a table in the shared folder; nothing is
    gathered, and the number of rounds grows with the logarithm of the longest
    chain.
    """
    links = kept_table(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        links = kept_table(small, "links")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def with_company(members: DataFrame) -> DataFrame:
    """The rows (``bucket``, ``id``, ...) of buckets with two ids or more, and the bucket's smallest, ``leader``."""
    leaders = members.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("_last"))
    return members.join(leaders.filter("leader < _last").drop("_last"), "bucket")


# Rounds in which every id meets one pivot, before what is left meets in pairs.
PIVOT_ROUNDS = 2


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(``id``, ``component``) after the links (a, b); links between components are few, however many ids they hold."""
    between = links.join(found.toDF("a", "_a"), "a", "left").join(found.toDF("b", "_b"), "b", "left").select(
        F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
    merged = kept_table(components(between), "merged")
    alone = merged.select("id", F.col("id").alias("component")).join(found, "id", "left_anti")
    return found.unionByName(alone).join(merged.toDF("component", "_merged"), "component", "left").select(
        "id", F.coalesce("_merged", "component").alias("component"))


def _open(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members with their component now, without the buckets that have become one."""
    now = members.select("bucket", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spans = now.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    return now.join(spans.filter("_low < _high").select("bucket"), "bucket").select("bucket", "id", "component")


def grouped(
    members: DataFrame, ids: DataFrame, compatible: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame], rounds: int = PIVOT_ROUNDS,
    late: tuple[Callable[[DataFrame], DataFrame], Callable[[str, str], Column]] | None = None,
    central: bool = False,
) -> DataFrame:
    """(``id``, ``component``) of the ids with links: as if all pairs of all buckets had been verified.

    ``members`` holds (``bucket``, ``id``), or a table of ``with_company``, ``ids`` one row
    per ``id`` with its traits.  First each id is tried against the leader of a bucket.  Then, for
    some rounds, each bucket names one of its members by lot, and each id is tried
    against one of those from another component.  Ids that this joins need no
    further look at one another, so afterwards only pairs from different
    components meet.  With ``central`` the first and then every other round names
    the member that shares most buckets with others.  ``compatible(x, y)`` is a necessary condition over the
    traits, whose names have these prefixes; it decides inside the join, so what
    it refuses is never a row.  ``late`` gives for the ids that are still open
    at the end traits that cost too much for all, and a necessary condition over
    these alone, which then holds beside the other.  ``verify`` keeps the pairs (a, b) that hold.  Every
    similar pair of a bucket therefore ends in one component, directly or through
    others.
    """
    spark = members.sparkSession
    if "leader" not in members.columns:
        members = kept_table(with_company(members), "buckets")
    traits = [c for c in ids.columns if c != "id"]

    def side(df: DataFrame, id_: str, name: str) -> DataFrame:
        return df.select(F.col(id_).alias(name), *[F.col(t).alias(f"{name}_{t}") for t in traits])

    def compatible_pairs(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side(ids, "id", "a"), "a").join(side(ids, "id", "b"), "b")
        return both.filter(compatible("a", "b")).select("a", "b")

    stars = members.filter("id != leader").groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a"))
    first = kept_alone(spark, lambda: verify(compatible_pairs(stars)), "verified")
    found = kept_alone(spark, lambda: components(first), "found")
    members = kept_alone(spark, lambda: _open(members, found), "open")
    for turn in range(rounds):
        if members.isEmpty():
            return found
        if central and turn % 2 == 0:
            # The member that shares most buckets with others is near the middle of its group.
            sizes = members.groupBy("bucket").agg(F.count("*").alias("_n"))
            weights = members.join(sizes, "bucket").groupBy("id").agg(F.sum("_n").alias("_w"))
            lot, among = F.struct(-F.col("_w"), F.xxhash64("id")), members.join(weights, "id")
        else:
            lot, among = F.xxhash64("id", F.lit(turn)), members
        lots = among.groupBy("bucket").agg(
            F.min_by(F.struct("id", "component"), lot).alias("_p"), F.count("*").alias("_n"))
        # Of an id's pivots the one of its largest bucket: a large group soon is one component.
        asked = members.join(lots, "bucket").filter(F.col("component") != F.col("_p.component")).groupBy(
            F.col("id").alias("b")).agg(F.max_by("_p.id", F.struct("_n", F.xxhash64("bucket"))).alias("a"))
        asked = compatible_pairs(asked)
        links = kept_alone(spark, lambda: verify(asked.select("a", "b")), "verified")  # noqa: B023
        if links.isEmpty():
            break
        before, open_ = found, members
        found = kept_alone(spark, lambda: _joined(before, links), "found")  # noqa: B023
        members = kept_alone(spark, lambda: _open(open_, found), "open")  # noqa: B023
    if members.isEmpty():
        return found
    last = members.join(ids, "id")
    if late is not None:
        more = late[0](members.select("id").distinct())
        last, traits = last.join(more, "id"), traits + [c for c in more.columns if c != "id"]
    members = kept_table(last, "rest")

    def renamed(name: str) -> DataFrame:
        return members.select(
            "bucket", F.col("id").alias(name), F.col("component").alias(f"{name}_component"),
            *[F.col(t).alias(f"{name}_{t}") for t in traits])

    a, b = renamed("a"), renamed("b").withColumnRenamed("bucket", "_bucket")
    on = (F.col("bucket") == F.col("_bucket")) & (F.col("a") < F.col("b")) & (
        F.col("a_component") != F.col("b_component")) & compatible("a", "b")
    if late is not None:
        on &= late[1]("a", "b")
    links = kept_alone(spark, lambda: verify(a.join(b, on).select("a", "b").distinct()), "verified")
    return found if links.isEmpty() else kept_alone(spark, lambda: _joined(found, links), "found")
