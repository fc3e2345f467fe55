"""Places of rows within ordered groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def ranked(df: DataFrame, group: Column, order: list[Column], place: str = "pos", total: str = "n") -> DataFrame:
    """df with _g, a struct of the group, each row's place in it from 0 by `order`, and the group's number of rows.

    Rows are dealt in ranges of (group, order), so that a hot group, or one place in it that many rows share, is split;
    they are numbered within their range, and what the ranges before hold of the group is added. Rows that tie are taken as
    they come. NULL is a group of its own and comes first, as do NULLs of `order`. An empty table gives an empty one.
    """
    names = [f"_o{i}" for i in range(len(order))] + ["_row"]
    d = df.withColumns({"_g": F.struct(group.alias("k")), "_row": F.monotonically_increasing_id()} | {f"_o{i}": c for i, c in enumerate(order)})
    d = d.repartitionByRange("_g", *names).withColumn("_range", F.spark_partition_id())
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy("_range", "_g").orderBy(*names))).drop(*names)
    d = written(d)  # the ranges are numbered once
    part = d.groupBy("_g", "_range").agg(F.count("*").alias("_c"))  # of a hot group a row a range
    by = Window.partitionBy("_g")
    part = part.withColumns({"_before": F.coalesce(F.sum("_c").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), total: F.sum("_c").over(by)}).drop("_c")
    d = d.join(part, ["_g", "_range"])
    return d.withColumn(place, F.col("_before") + F.col("_i") - 1).drop("_before", "_i", "_range")
