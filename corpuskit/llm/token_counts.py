"""Token counts by a two-tier lookup in the map task; no pre-token is shuffled."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.rows import packed, small_batches, unpacked, whole_text
from corpuskit.llm.tokenizing import BYTE_PATTERN, cut_here, encode, lengths


def frequent_lengths(
    docs: DataFrame, file: str, text: str = "text", entries: int = 65_536, sample_rows: int = 20_000,
) -> dict[str, int]:
    """Token lengths of the ``entries`` most frequent pre-tokens of about ``sample_rows`` rows.

    The table only saves time: counts do not depend on what is in it.  Each task
    of the sample emits at most ``entries`` pre-tokens, and so does the result.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    some = docs.select(whole_text(text).alias("text"))
    some = some.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else some

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch["text"]:
                if cut_here(value):
                    seen.update(BYTE_PATTERN.findall(value))
            if len(seen) > 16 * entries:
                seen = Counter(dict(seen.most_common(entries)))
        yield pd.DataFrame(seen.most_common(entries), columns=["piece", "n"])

    top = (
        some.mapInPandas(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(entries))
    return {row.piece: len(encode(file, row.piece)) for row in top.collect()}


def token_counts(docs: DataFrame, file: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    First tier: the broadcast table of frequent pre-tokens.  Second tier: a
    bounded cache in each Python worker, filled by encoding a missed pre-token
    alone.  Special strings in a text count as the library's default has them.
    Null and empty texts have no tokens.
    """
    small_batches(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, file, text))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        first, second = frequent.value.get, lengths(file)

        def of(value: str) -> int:
            if not cut_here(value):
                return len(encode(file, value))
            pieces = BYTE_PATTERN.findall(value)
            found = list(map(first, pieces))
            total = 0
            for piece, n in zip(pieces, found):
                total += second[piece] if n is None else n
            return total

        for batch in batches:
            yield batch.map(of)

    df = packed(docs, _text=whole_text(text)).withColumns({
        "n_bytes": F.octet_length("_text").cast("long"), "n_tokens": count("_text")})
    return unpacked(df.withColumn("over_limit", F.col("n_tokens") > limit), docs, "n_bytes", "n_tokens", "over_limit")
