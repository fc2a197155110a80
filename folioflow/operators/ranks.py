"""Ranks within groups that no task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import written


def placed(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rows sorted over all partitions and written, with ``at``: the partition's number in the upper bits, the place in it below."""
    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add each row's rank within its group, from 0; rows of one group and order come in any order, nulls first.

    A group is spread over as many partitions as its rows fill.  A run, the rows of a group within a partition, is one row of
    a small table that tells how many came before it; so a group of all rows is no more than a row a partition there.
    """
    rows = placed(rows, *(F.col(c).asc_nulls_first() for c in [*group, *order]))
    part = F.shiftrightunsigned("at", 33)
    runs = rows.groupBy(*group, part.alias("part")).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"run_{c}") for c in group), F.col("part").alias("run_part"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start")).alias("shift"))
    on = part == F.col("run_part")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"run_{c}"))
    return rows.join(runs, on).withColumn(name, F.col("at") + F.col("shift")).drop("at", "shift", "run_part", *(f"run_{c}" for c in group))
