"""Global ranks without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans.staging import staged


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds each row's position (from 0) in the given total order.

    The rows are dealt into ranges, written with the number of their range,
    and counted by it; a row's rank is its place in its range plus the sizes
    of the ranges before.  Only the ranges, as many as partitions, are ever
    ordered in one task.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = staged(parts, "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(sizes, "_part").withColumn(name, (place + F.col("_before")).cast("long")).drop("_part", "_before")


def running_total(df: DataFrame, keys: list[str], by: str, value: Column, name: str, bits: int = 16) -> DataFrame:
    """Adds the sum of value over the rows of the same keys up to this one,
    in the order of by (a distinct long within the keys).

    Runs of 2**bits consecutive numbers are added up apart; the totals of the
    runs before come from a table with a row per run.  A group however large
    is so many tasks.
    """
    rows = df.withColumn("_run", F.shiftright(by, bits)).withColumn("_value", value)
    within = F.sum("_value").over(Window.partitionBy(*keys, "_run").orderBy(by))
    runs = rows.groupBy(*keys, "_run").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    return rows.withColumn("_within", within).join(runs, [*keys, "_run"]).withColumn(name, F.col("_within") + F.col("_before")).select(*df.columns, name)
