"""Making Catalyst compute a column once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *columns: str) -> DataFrame:
    """Compute ``columns`` here, once per row.

    Catalyst merges projections and pushes filters through them, copying the
    expressions; inside array lambdas a copied expression then runs once per
    element.  A generator over a one-element array is a step it does not merge
    or push through.  It costs one small array per row and no shuffle.
    """
    rest = [c for c in df.columns if c not in columns]
    once = df.select(*rest, F.explode_outer(F.array(F.struct(*columns))).alias("_settled"))
    return once.select(*[F.col(f"_settled.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
