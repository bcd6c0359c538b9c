"""Join helpers.  Which side of a join is broadcast is left to the byte threshold of the planner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row per key in ``order``: ``row_number() = 1``, which Spark plans with a
    partial WindowGroupLimit before the shuffle, so each map partition sends at most
    one row per key (a hot key is cut map-side, like a partial aggregate)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first_rn", F.row_number().over(w)).filter(F.col("_first_rn") == 1).drop("_first_rn")
