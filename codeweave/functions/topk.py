"""Skew-safe top-k per group.

A plain ``row_number() over (partition by g order by ...)`` sends every row of
a group to one task -- fatal when one group holds a third of the data.  Here
the group is first split into ``salt`` sub-groups (hash of a row key), each
keeps its own top k, and only ``salt * k`` candidates per group meet in the
final window.  The result equals the unsalted top k for any total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_cols: list[str] | None = None, salt: int = 64, rank_col: str = "rank") -> DataFrame:
    salt_cols = salt_cols or [c for c in df.columns if c not in group_cols]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(salt)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    first = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
