"""Running sums within groups of any size, without a window over a whole group.

``sum() over (partition by g order by ...)`` sorts a group in one task.  Here the
rows are range-partitioned by group *and* order, so a large group lies in many tasks;
a task sums its own share, and the totals of the shares before it (one row a task and
group) are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeweave.session import cut_lineage


def running_sums(df: DataFrame, groups: list[str], order: list[str], value: str | None = None, before: str = "before",
                 total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` (rows, if not given) over the rows before each one in its group.

    ``order`` are names of columns, ascending; rows equal in all of them are told apart in
    some fixed order.  ``total`` names a column for the sum of the whole group, if wanted.
    Null groups are groups.  The rows are written once under the checkpoint folder.
    """
    keys = [*groups, *order]
    v = F.lit(1).cast("long") if value is None else F.coalesce(F.col(value), F.lit(0))
    placed = cut_lineage(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    share = Window.partitionBy("_task", *groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_own", F.coalesce(F.sum(v).over(share), F.lit(0)))
    shares = placed.groupBy("_task", *groups).agg(F.sum(v).alias("_sum"))
    tasks = Window.partitionBy(*groups)  # a row a task
    shares = shares.select(F.col("_task").alias("_t"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
                           F.coalesce(F.sum("_sum").over(tasks.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                           *([F.sum("_sum").over(tasks).alias(total)] if total else []))
    on = F.col("_task") == F.col("_t")
    for i, g in enumerate(groups):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(shares, on).withColumn(before, F.col("_base") + F.col("_own")) \
        .drop("_at", "_task", "_own", "_t", "_base", *[f"_g{i}" for i in range(len(groups))])
