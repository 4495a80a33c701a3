"""Documents to index rows: clean, chunk, embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators import chunking, cleaning, embedding


def ingest(
    documents: DataFrame, encoder: embedding.EncoderFactory, collection: Column, model: str = "",
    provider: str = "", strategy: str = "heading_aware", batch_size: int = 32, **options,
) -> DataFrame:
    """Index rows for documents (doc_id, text, further columns are inherited).

    One chain without a shuffle: tasks end where the writer begins.
    """
    named = documents.withColumn("collection", collection)
    cleaned = cleaning.clean(named, out="text")
    chunks = chunking.chunk(cleaned, strategy, **options)
    return embedding.embed(chunks, encoder, model, provider, batch_size)
