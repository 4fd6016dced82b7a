"""Consecutive numbers for the rows of a sorted table, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.sources.scratch import written


def numbered(df: DataFrame, *order: Column | str, name: str = "id") -> tuple[DataFrame, int]:
    """``df`` with 0, 1, 2, ... in sort order, and the number of rows.

    A row's number is its place in its part of the sorted table plus the rows of
    the parts before; only the parts' row counts come to the driver.
    """
    ordered = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(r.part), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    number = (start + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")
    return ordered.withColumn(name, number).drop("_at"), before
