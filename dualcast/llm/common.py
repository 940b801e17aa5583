"""What the text operators share: word classes, Arrow passes, stored intermediates and reading tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dualcast.session import materialize, scratch

#: The characters between words.
SPACES = " \t\n\x0b\x0c\r"
#: Rows per Arrow batch; a text may be very long, so a batch holds few of them.
BATCH_ROWS = 128
#: Bytes per batch and slice; very long texts come in smaller ones.
BATCH_BYTES = 2 << 20

__all__ = ["BATCH_ROWS", "SPACES", "arrow_pass", "cells", "materialize", "scratch", "split_words", "table", "text_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column | str) -> Column:
    """A text column with null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """The runs of characters other than white space, in order."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def cells(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def arrow_pass(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, rows: int = BATCH_ROWS
) -> DataFrame:
    """``mapInArrow`` over slices of at most so many rows and ``BATCH_BYTES``, unless one row alone is larger.

    The session's limit of bytes per batch is lowered where it is higher; its limit of rows stays as it is, so
    other functions keep their batches of many short rows.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(name, None)
    if held is None or not held.rstrip("bB").isdigit() or int(held.rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(part for batch in batches for part in slices(batch, rows))

    return df.mapInArrow(sliced, schema)


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded rows and bytes."""
    each = max(1, min(rows, int(most * max(1, len(batch)) / max(1, batch.get_total_buffer_size()))))
    for at in range(0, len(batch), each):
        yield batch.slice(at, each)
