"""Consecutive numbers over a whole table, without one task or one group that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.storage import materialize

#: rows of one partition that a number made by Spark tells apart
INSIDE = (1 << 33) - 1


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0, by ``order`` within ``group``) and ``members`` (rows of the group).

    Rows are cut into ranges over all partitions, so a group of any size spreads; each stretch of a group in a
    partition then gets its start from the stretches before it, of which a group has one for each partition at
    most. ``group`` is not null, ``order`` tells all rows apart or leaves equal ones in any order.
    """
    cut = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(INSIDE))
    placed = materialize(cut.withColumns({"_part": F.spark_partition_id(), "_at": at}), "placed")
    stretches = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select(
        group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_n").over(whole).alias("members"))
    numbers = placed.join(starts, [group, "_part"]).withColumn("pos", F.col("_start") + F.col("_at"))
    return numbers.select(*rows.columns, "pos", "members")
