"""Running an encoder over texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.skew import join_copies

Encode = Callable[[Sequence[str]], Sequence[Sequence[float]]]
EncoderFactory = Callable[[], Encode]


def encode_column(text: Column, factory: EncoderFactory, batch_size: int = 32) -> Column:
    """struct(embedding, error) per text.

    The factory runs once per task, so a model is loaded once.  A batch that
    fails gives empty vectors and the error text, and the job goes on.
    """

    @F.pandas_udf("embedding array<double>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for series in batches:
            vectors: list = []
            errors: list = []
            for at in range(0, len(series), batch_size):
                part = series.iloc[at:at + batch_size].tolist()
                try:
                    got = [list(map(float, v)) for v in encode(part)]
                    if len(got) != len(part):
                        raise ValueError(f"{len(got)} vectors for {len(part)} texts")
                    vectors += got
                    errors += [None] * len(part)
                except Exception as exc:  # noqa: BLE001 - reported as a row
                    vectors += [[] for _ in part]
                    errors += [f"{type(exc).__name__}: {exc}"] * len(part)
            yield pd.DataFrame({"embedding": vectors, "error": errors})

    return run(text)


def embed(
    df: DataFrame, factory: EncoderFactory, model: str = "", provider: str = "", batch_size: int = 32,
) -> DataFrame:
    """Add embedding, error, dimensions, embedding_model, embedding_provider."""
    return (
        df.withColumn("_e", encode_column(F.col("text"), factory, batch_size))
        .select(
            *df.columns, F.col("_e.embedding").alias("embedding"), F.col("_e.error").alias("error"),
            F.size("_e.embedding").alias("dimensions"),
            F.lit(model).alias("embedding_model"), F.lit(provider).alias("embedding_provider"))
    )


def embed_distinct(
    df: DataFrame, factory: EncoderFactory, model: str = "", provider: str = "", batch_size: int = 32,
    known: DataFrame | None = None,
) -> DataFrame:
    """Encode every distinct text once, keyed by SHA-256, and fan the vectors out.

    ``known``: earlier results (text_key, embedding, dimensions); their texts are
    not encoded again.  Adds text_key, embedding and dimensions.
    """
    keyed = df.withColumn("text_key", F.sha2("text", 256))
    counted = keyed.groupBy("text_key", "text").agg(F.count(F.lit(1)).alias("copies"))
    todo = counted.select("text_key", "text")
    if known is not None:
        todo = todo.join(known.select("text_key"), "text_key", "left_anti")
    vectors = embed(todo, factory, model, provider, batch_size).select(
        "text_key", "embedding", "dimensions")
    if known is not None:
        vectors = vectors.unionByName(known.select("text_key", "embedding", "dimensions"))
    return join_copies(keyed, vectors, ["text_key"], counted.select("text_key", "copies"))


def embedding_stats(embedded: DataFrame, batch_size: int = 32) -> DataFrame:
    """Totals, failures, dimensions and batch count per model and provider."""
    done = F.size("embedding") > 0
    return embedded.groupBy("embedding_model", "embedding_provider").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("embedded"),
        F.count_if(~done).alias("failed"),
        F.max(F.size("embedding")).alias("dimensions"),
        F.ceil(F.count(F.lit(1)) / batch_size).alias("batches"),
    )


# --- small encoders for tests and trials ------------------------------------


def measure_encoder() -> Encode:
    """[characters, words, lines] of a text."""
    return lambda texts: [[len(t), len(t.split()), t.count("\n") + 1] for t in texts]


def hashing_encoder(dims: int) -> EncoderFactory:
    """Unit vectors of signed word counts, hashed into ``dims`` places."""

    def factory() -> Encode:
        def encode(texts: Sequence[str]) -> list[np.ndarray]:
            out = []
            for text in texts:
                v = np.zeros(dims)
                for word in text.lower().split():
                    h = xxhash.xxh64_intdigest(word)
                    v[h % dims] += 1.0 if h & (1 << 63) else -1.0
                size = np.linalg.norm(v)
                out.append(v / size if size > 1e-12 else v)
            return out

        return encode

    return factory
