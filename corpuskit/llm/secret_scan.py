r"""Secrets by corpus-wide ownership: copied examples apart from live-looking values.

Native functions only.  The scan is a map over documents.  Only candidate hashes
are shuffled; they are first reduced to distinct (value, owner, repository), so a
value that stands in a third of all documents meets as one row per owner and
repository, and counts are finished in two steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.settle import settle
from corpuskit.llm.rows import kept_table, packed, unpacked, whole_text
from corpuskit.operators.skew import join_copies

# Kind, pattern, the group that holds the value, its smallest length.
BASE = (
    ("assign",
     r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("map", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
)
KINDS = BASE + MORE


def _spans(text: str, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """All matches of one kind with code-point offsets, those failing the length dropped.

    Between the matches stand the pieces that ``split`` gives, so a running sum
    of piece and match lengths is the place of each match.
    """
    shape = "array<struct<start:int,kind_order:int,end:int,kind:string,value:string>>"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    found = F.aggregate(
        F.arrays_zip(F.split(text, pattern).alias("piece"), matches.alias("hit"), values.alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["piece"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"),
            F.when(F.char_length(x["value"]) >= least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.char_length(x["piece"])).alias("start"), F.lit(order).alias("kind_order"),
                (acc["at"] + F.char_length(x["piece"]) + F.char_length(x["hit"])).alias("end"),
                F.lit(kind).alias("kind"), x["value"].alias("value"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.col(text).rlike(pattern if kind != "hex" else r"[0-9a-f]{24}"), found).otherwise(
        F.array().cast(shape))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``: the spans of every kind by start, then kind as listed.

    Each has start, end (exclusive), kind and value; positions are code points.
    Null and empty texts have none.
    """
    df = packed(docs, _text=whole_text(text))
    parts = [_spans("_text", kind, pattern, group, least, i) for i, (kind, pattern, group, least) in enumerate(KINDS)]
    df = settle(df.withColumn("secrets", F.sort_array(F.concat(*parts))), "secrets")
    return unpacked(df, docs, "secrets")


# From so many owners on, or documents of whatever owner, a value is an example; from so many on it is shared.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
SHARED_OWNERS, SHARED_REPOSITORIES = 2, 3
# Occurrences from which on a value is dealt out over tasks where they meet its counts, and how many such values at most.
HOT_ROWS = 1_000
HOT_VALUES = 100_000


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """Per value hash: distinct ``owners`` and ``repositories``, ``copies`` (occurrences) and ``verdict``.

    A value of many owners, or copied into many repositories of one, is an
    ``example``; one of a few is ``shared``; the rest is ``live``.  A null owner or
    repository counts as one of its own.
    """
    named = found.select(
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repository"),
        F.explode(F.transform("secrets", lambda x: F.xxhash64(x["value"]))).alias("value_hash"))
    # One row per (value, owner) before the value alone is the key.
    by_repository = named.groupBy("value_hash", "_owner", "_repository").agg(F.count("*").alias("copies"))
    by_owner = by_repository.groupBy("value_hash", "_owner").agg(
        F.count("*").alias("repositories"), F.sum("copies").alias("copies"))
    counts = by_owner.groupBy("value_hash").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("copies").alias("copies"))

    def many(owners: int, repositories: int):
        return (F.col("owners") >= owners) | (F.col("repositories") >= repositories)

    return counts.withColumn("verdict", F.when(many(EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES), "example").when(
        many(SHARED_OWNERS, SHARED_REPOSITORIES), "shared").otherwise("live"))


def secret_scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id",
) -> DataFrame:
    """Spans of each row and how widely their values are owned.

    Returns the key, ``secrets``, ``uses`` (for each span its ``owners``,
    ``repositories`` and ``verdict``), ``n_live``, ``n_shared``, ``n_example``.
    Texts are scanned once.  Rows that hold secrets meet the ownership counts by
    value hash; all others skip that join.  Rows are told apart by number, so
    repeated rows and null keys are rows like others, and other columns of the
    input are not looked at.
    """
    named = docs.select(
        F.col(key).alias("_key"), F.col(owner).alias("_owner"), F.col(repository).alias("_repository"),
        F.col(text).alias("_text"))
    found = find_secrets(named, "_text").drop("_text").withColumn("_uid", F.monotonically_increasing_id())
    found = kept_table(found, "secrets")
    with_any = found.filter(F.size("secrets") > 0)
    counts = kept_table(ownership(with_any, "_owner", "_repository"), "owned")
    hits = with_any.select("_uid", F.posexplode(F.transform(
        "secrets", lambda x: F.xxhash64(x["value"]))).alias("_at", "value_hash"))
    judged = join_copies(
        hits, counts.drop("copies"), ["value_hash"], counts.select("value_hash", "copies"),
        max(HOT_ROWS, with_any.count() // HOT_VALUES))
    judged = judged.groupBy("_uid").agg(F.sort_array(F.collect_list(
        F.struct("_at", "owners", "repositories", "verdict"))).alias("_uses"))
    uses = F.transform(
        F.coalesce("_uses", F.array().cast("array<struct<_at:int,owners:bigint,repositories:bigint,verdict:string>>")),
        lambda u: F.struct(u["owners"].alias("owners"), u["repositories"].alias("repositories"), u["verdict"].alias("verdict")))
    return found.join(judged, "_uid", "left").select(
        F.col("_key").alias(key), "secrets", uses.alias("uses")).select(
        "*", *[F.size(F.filter("uses", lambda u: u["verdict"] == v)).cast("long").alias(f"n_{v}")  # noqa: B023
               for v in ("live", "shared", "example")])
