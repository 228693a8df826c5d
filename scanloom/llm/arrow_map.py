"""A frame with more columns, made from one of its columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MOST_BYTES = 4 << 20
Maker = Callable[[pa.Array], list[pa.Array]]


def with_columns(df: DataFrame, column: str, made: list[tuple[str, str]], start: Callable[[], Maker]) -> DataFrame:
    """df and the columns `made` (name, Spark type); start() runs once in each task and returns the
    function that turns a batch of `column` into the new arrays. No shuffle; partitions stay."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {t}" for n, t in made]
    at, names = df.columns.index(column), [n for n, _ in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for whole in batches:
            step = max(1, whole.num_rows * MOST_BYTES // max(whole.nbytes, 1))
            for first in range(0, whole.num_rows, step):  # a few MB at a time, however large the texts
                batch = whole.slice(first, step)
                yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at))], [*batch.schema.names, *names])

    return df.mapInArrow(run, ", ".join(fields))
