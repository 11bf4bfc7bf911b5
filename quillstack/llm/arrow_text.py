"""Arrow-batch plumbing for operators that walk whole texts in Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of text turned into Python objects at a time; bounds a worker's memory beside the Arrow batch
#: itself, which Spark cuts by spark.sql.execution.arrow.maxBytesPerBatch. A longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


def slices(batch: pa.RecordBatch, column: int | str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and, but for single rows, SLICE_BYTES in the string ``column``."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, ends = 0, np.cumsum(size)
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")) - at
        n = max(1, min(SLICE_ROWS, fit))
        yield batch.slice(at, n)
        at += n


def map_texts(docs: DataFrame, schema: str | StructType, make: Callable[[], Callable[[list], list]], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of (*keys, *columns): ``make()`` is called once a task, and what it returns turns a list of texts
    (null read as empty) into a list of columns, each as long as the list. ``schema`` names all columns."""
    fields = docs.select(*keys).schema
    target = StructType(list(fields.fields) + list((schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).fields))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, "_text"):
                made = f([x or "" for x in part.column("_text").to_pylist()])
                cols = [part.column(i) for i in range(len(keys))]
                cols += [pa.array(c, type=arrow.field(len(keys) + i).type) for i, c in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) if i < len(keys) else c for i, c in enumerate(cols)], schema=arrow)

    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(work, target)
