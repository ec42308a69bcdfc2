"""Arrow batches of bounded size for the few steps that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes of one Arrow batch that goes to Python, and bytes that are unpacked at a time: very long texts must not meet in one batch by thousands.
BATCH_ROWS, BATCH_BYTES, PIECE_BYTES = 1000, 16 << 20, 2 << 20


def arrow_batches(df: DataFrame) -> DataFrame:
    """Sets the size of the batches in which ``df`` goes to Python, for its session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def pieces(batches: Iterator[pa.RecordBatch], size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of ``size`` bytes at most, or one row; without empty ones."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Maps Arrow batches. ``make`` runs once in each task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in pieces(batches):
            if (out := each(batch)) is not None:
                yield out

    return arrow_batches(df).mapInArrow(run, schema)
