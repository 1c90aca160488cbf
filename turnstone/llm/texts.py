"""Appends columns computed from a text column, batch by batch; all other columns pass as Arrow, so nulls and large numbers stay as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from turnstone.llm.scratch import prepare

ROWS = 256  #: rows whose texts are Python strings at once


def append(df: DataFrame, text_col: str, fields: str, make: Callable[[], Callable[[list[str]], Sequence[Sequence]]], rows: int = ROWS) -> DataFrame:
    """df with more columns. ``make`` is called once a task; what it returns maps texts (null as "", a null list as an empty one) to one sequence per field of ``fields``."""
    prepare(df.sparkSession)
    added = StructType.fromDDL(fields)
    df = df.drop(*added.names)
    lists = df.schema[text_col].dataType.typeName() == "array"
    types = [f.type for f in to_arrow_schema(added)]
    names, at = [*df.columns, *added.names], df.columns.index(text_col)
    schema = StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, none = make(), [] if lists else ""
        for whole in batches:
            for s in range(0, whole.num_rows, rows):
                b = whole.slice(s, rows)
                columns = work([none if t is None else t for t in b.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)
        del work
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)
