"""Running values in arrival order without one task per key.

A plain window over a station would put all of a hot station's rows into one task. Rows are instead
cut into chunks of consecutive arrival numbers: each chunk is windowed by itself and a one-row
summary per chunk carries the state across. ``seq`` is unique, so a chunk never holds more than
``chunk_rows`` rows of a key, and the summaries number at most (seq range / chunk_rows) per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.expr import div
from tidewatch.session import materialize

# chunks over all keys: short enough that a dense stream crosses one within the allowed delay
CHUNK_ROWS = 1 << 14
# chunks scanned by one task before the scan over groups of chunks: 10^12 rows make 15,000 groups
GROUP_CHUNKS = 1 << 12
# chunks of single keys are longer: a key with a third of all rows still fills tasks of a few million,
# and with very many keys a summary still stands for several rows
KEY_CHUNK_ROWS = 1 << 24


def chunk_of(seq: Column, chunk_rows: int) -> Column:
    return div(seq, chunk_rows)


def key_chunks(rows: DataFrame, keys: list[str], chunk_rows: int = KEY_CHUNK_ROWS) -> tuple[DataFrame, bool]:
    """Add ``chunk``: consecutive numbers from 0 over stretches of a key's arrivals, of fewer than 2 * ``chunk_rows``
    rows each. Also returns whether any key has more than one chunk.

    Cells of ``chunk_rows`` arrival numbers are counted by partial aggregation; neighbouring cells of a key join one
    chunk until it is full, so that a key with few rows in a cell is not cut at every cell.
    """
    cells = rows.withColumn("_cell", chunk_of(F.col("seq"), chunk_rows))
    counts = cells.groupBy(*keys, "_cell").agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    numbered = materialize(counts.select(*keys, "_cell", div(before, chunk_rows).alias("chunk")), "chunks")
    if numbered.filter("chunk > 0").isEmpty():
        return rows.withColumn("chunk", F.lit(0).cast("long")), False
    return cells.join(numbered, [*keys, "_cell"]).drop("_cell"), True


def earlier_chunks(keys: list[str]) -> WindowSpec:
    """All chunks of the key before the current one; runs over chunk summaries only."""
    return (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _within_chunks(chunked: DataFrame, keys: list[str], name: str, include_current: bool) -> DataFrame:
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy("seq")
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    return chunked.withColumn(
        name, F.greatest(F.max("_value").over(local), F.col("_carried"))
    ).drop("_value", "_chunk", "_carried")


def previous_max(
    rows: DataFrame,
    value: Column,
    name: str,
    unaffected: Callable[[Column, Column], Column],
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether the maximum of ``value`` over all earlier arrivals can matter to them.

    ``unaffected(lowest, highest)`` tells from a chunk's lowest value and the highest value up to
    its end that none of its rows depends on the exact maximum. Returns (rows of such chunks, rows
    of the others with ``name`` added). Only the latter are shuffled; when arrivals are nearly in
    order there are none. The list of other chunks is written out, so the planner knows its real
    size and broadcasts it only while it is small.
    """
    chunked = rows.withColumns({"_value": value, "_chunk": chunk_of(F.col("seq"), chunk_rows)})
    summaries = chunked.groupBy("_chunk").agg(
        F.min("_value").alias("_low"), F.max("_value").alias("_high")
    ).withColumn("_group", chunk_of(F.col("_chunk"), GROUP_CHUNKS))
    groups = (
        summaries.groupBy("_group")
        .agg(F.max("_high").alias("_group_high"))
        .withColumnRenamed("_group", "_chunk")
        .withColumn("_group_carried", F.max("_group_high").over(earlier_chunks([])))
        .select(F.col("_chunk").alias("_group"), "_group_carried")
    )
    summaries = summaries.join(groups, "_group").withColumn(
        "_carried", F.greatest(F.max("_high").over(earlier_chunks(["_group"])), "_group_carried")
    )
    affected = materialize(
        summaries.filter(~unaffected(F.col("_low"), F.greatest("_high", "_carried"))).select(
            "_chunk", "_carried"
        ),
        "affected-chunks",
    )
    settled = chunked.join(affected, "_chunk", "left_anti").drop("_value", "_chunk")
    return settled, _within_chunks(chunked.join(affected, "_chunk"), [], name, include_current=False)
