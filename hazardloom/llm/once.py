"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row, however often later expressions and lambdas name it.

    A plain column would be put in the place of each of its names; an exploded array of one element is not.
    """
    return df.withColumn(name, F.explode(F.array(value)))
