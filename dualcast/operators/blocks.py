"""Time blocks: bounded window groups for series of any length.

``time_index`` is contiguous inside a series, so a series can be cut into blocks of a fixed number
of rows. A block also receives the last ``rows_back`` rows of the block before it, marked as
context. Windows then run per (series, block): no task ever holds more than one block plus its
context, however long one series is, and every look-back of at most ``rows_back`` rows stays exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dualcast.settings import KEYS

# a block and its context stay below the 4096 rows that a window keeps in its plain in-memory buffer
BLOCK_ROWS = 3840


def with_history(
    df: DataFrame, rows_back: int, index: str = "time_index", block_rows: int | None = None
) -> DataFrame:
    """Add ``_block`` and ``_context``; rows near a block's end also go to the next block as context."""
    size = max(block_rows or BLOCK_ROWS, rows_back)
    own = F.expr(f"`{index}` div {size}")
    near_end = F.expr(f"`{index}` % {size} >= {size - rows_back}")
    targets = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_block", F.explode(targets)).withColumn("_context", F.col("_block") != own)


def over_history(
    df: DataFrame,
    rows_back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    keys: Sequence[str] = KEYS,
    index: str = "time_index",
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``build(df, window)`` with exact look-backs; a frame that is already in blocks is used as is."""
    window = Window.partitionBy(*keys, "_block").orderBy(index)
    if "_block" in df.columns:
        return build(df, window)
    blocked = with_history(df, rows_back, index, block_rows)
    return build(blocked, window).where(~F.col("_context")).drop("_block", "_context")


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str] = KEYS,
    rows: str = "n",
    how: str = "inner",
    index: str = "time_index",
    block_rows: int | None = None,
) -> DataFrame:
    """Join one row per series to a panel without piling a long series into one task.

    ``table[rows]`` holds the series length. The table gets one copy per block, so the join key is
    (series, block): a small side is turned into a broadcast at run time from its measured size, and
    a large side still meets at most one block of panel rows per key. On a frame that is already in
    blocks the join reuses the partitioning of its windows.
    """
    block_rows = block_rows or BLOCK_ROWS
    blocked = "_block" in df.columns
    slot = "_block" if blocked else "_slot"
    last = F.expr(f"cast(`{rows}` as bigint) div {block_rows}")
    spread = table.withColumn(slot, F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    if rows in df.columns and rows not in keys:
        spread = spread.drop(rows)
    if not blocked:
        df = df.withColumn(slot, F.expr(f"`{index}` div {block_rows}"))
    joined = df.join(spread, [*keys, slot], how)
    return joined if blocked else joined.drop(slot)


def rows_so_far(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "_row", index: str = "time_index") -> DataFrame:
    """How many rows of its series come before each row: counted inside its block, plus the blocks before.

    Gaps in the index do not matter. Rows without an index count and come first; rows with a null key belong
    to no series and are left out.
    """
    blocked = df.withColumn("_slot", F.coalesce(F.expr(f"`{index}` div {BLOCK_ROWS}"), F.lit(-1).cast("bigint")))
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    counts = blocked.groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*keys, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_slot").orderBy(index))
    joined = blocked.join(offsets, [*keys, "_slot"])
    return joined.withColumn(name, F.col("_offset") + inside - 1).drop("_slot", "_offset")


def full_frame(window: WindowSpec, rows: int, current: bool = False) -> tuple[WindowSpec, Column]:
    """A frame of exactly ``rows`` rows and the condition that it is full."""
    frame = window.rowsBetween(-(rows - 1), 0) if current else window.rowsBetween(-rows, -1)
    return frame, F.count(F.lit(1)).over(frame) == rows
