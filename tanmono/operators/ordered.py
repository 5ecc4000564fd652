"""Order-dependent steps inside large groups, without one task for a whole group.

A group's rows are cut into chunks of their order value. Windows run inside chunks; what must come from earlier chunks
is carried over by a window on one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tanmono.plans.storage import materialize


def with_previous(df: DataFrame, group: list[str], order: list[str], chunk: Column, values: list[str], name: str = "prev") -> DataFrame:
    """df with the struct name of the preceding row's values, null for a group's first row.

    order is a total order whose first column never decreases with chunk.
    """
    df = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    df = df.withColumn("_first", F.row_number().over(inside) == 1).withColumn(name, F.lag(F.struct(*values)).over(inside))
    last = df.groupBy(*group, "_chunk").agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*group).orderBy("_chunk"))
    carried = last.withColumn("_before", before).select(*group, "_chunk", "_before")
    joined = df.join(carried, [*group, "_chunk"], "left")
    joined = joined.withColumn(name, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(name))).drop("_first", "_before", "_chunk")
    return materialize(joined, "previous")  # the next step reads it for its rows and for the ends of its chunks


def with_island(df: DataFrame, group: list[str], order: list[str], chunk: Column, starts: Column, key: str, name: str = "island") -> DataFrame:
    """df with the key of the last row, at or before each row, where starts holds; a group's first row must start one."""
    df = df.withColumn("_chunk", chunk).withColumn("_key", F.when(starts, F.col(key)))
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(name, F.last("_key", ignorenulls=True).over(inside))
    last = df.filter("_key IS NOT NULL").groupBy(*group, "_chunk").agg(F.max_by("_key", F.struct(*order)).alias("_last"))
    chunks = df.select(*group, "_chunk").distinct().join(last, [*group, "_chunk"], "left")
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).drop("_last")
    joined = df.join(carried, [*group, "_chunk"], "left")
    return joined.withColumn(name, F.coalesce(name, "_before")).drop("_chunk", "_key", "_before")
