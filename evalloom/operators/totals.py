"""One-row totals beside every row, as a scalar subquery: nothing is joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df and the columns of ``totals``, which has exactly one row, such as an aggregate without groups."""
    one = totals.select(F.struct(*totals.columns).alias("_t")).scalar()
    return df.withColumn("_t", one).select(*df.columns, "_t.*")
