"""Column helper shared by the text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``withColumn`` for a costly value that several later steps read.

    A plain projection may be merged into its readers, and a filter on the column is
    pushed below it with the whole expression copied in; a chain of text steps then
    grows exponentially.  A one-element explode keeps the value as it is: computed once
    per row, while filters on other columns still move below it.
    """
    if name not in df.columns:
        return df.select("*", F.explode(F.array(value)).alias(name))
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name)).select(df.columns)
