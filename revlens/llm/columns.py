"""Work on the texts of whole rows in Arrow batches.

Rows travel under names of their own, so columns may be called anything, and each text is sent once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def give_back() -> None:
    """Gives the system what a task's Arrow pool and freed arrays still hold: the process goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def renamed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as ``_c0``, ``_c1``, ..."""
    return rows.select(*[F.col(quoted(name)).alias(f"_c{place}") for place, name in enumerate(names)])


def append_columns(rows: DataFrame, text: str, fields: list[T.StructField],
                   start: Callable[[], Callable[[list[str | None]], list[list]]]) -> DataFrame:
    """``rows`` with new columns computed from the text column, batch by batch.

    ``start()`` runs once in a task and returns a function from texts to one list of values for
    each field. Old columns named like a new one (in any case) are replaced.
    """
    taken = {field.name.lower() for field in fields}
    kept = [name for name in rows.columns if name.lower() not in taken]
    given = kept if text in kept else [*kept, text]
    place = given.index(text)
    schema = T.StructType([rows.schema[name] for name in kept] + fields)
    kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}
    arrow = [kinds[type(field.dataType)] for field in fields]
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(batch.column(place).to_pylist())
            columns = batch.columns[: len(kept)] + [pa.array(values, kind) for values, kind in zip(made, arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return renamed(rows, given).mapInArrow(work, schema)


def keep_rows(rows: DataFrame, text: str, start: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """Rows whose text passes, with all their columns as they came.

    ``start()`` runs once in a task and returns a function from texts to whether each stays.
    """
    place = rows.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = start()
        for batch in batches:
            found = batch.filter(pa.array(passes(batch.column(place).to_pylist()), pa.bool_()))
            yield pa.RecordBatch.from_arrays(found.columns, names=rows_names)
        give_back()

    rows_names = rows.columns
    return renamed(rows, rows.columns).mapInArrow(work, rows.schema)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
