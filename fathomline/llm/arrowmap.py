"""Row-wise functions over Arrow batches: one result row for each input row."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

#: Gets the text column and its length, gives the arrays of the result columns.
TextFunction = Callable[[pa.Array], list]


def tidy(run):
    """``run`` over batches, after which the worker gives freed memory back to the system.

    Workers are reused, and both Arrow's pool and the C library keep what was freed; an executor
    would hold the peaks of all earlier steps beside the present one's.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def map_text(df: DataFrame, text: str, make: Callable[[], TextFunction], result: StructType, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and, beside them, the columns that a text function gives.

    ``make`` runs once in each task and returns the function, so that a task can
    hold tables. Result names must not clash with ``keep``; see ``add_struct``.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = StructType([*kept.schema.fields[:-1], *result.fields])
    arrow = to_arrow_schema(schema)
    width = len(keep)

    def run(batches):
        apply = make()
        for batch in batches:
            made = apply(batch.column(width))
            columns = [*batch.columns[:width], *made]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(tidy(run), schema)


def add_struct(df: DataFrame, text: str, make: Callable[[], TextFunction], result: StructType) -> tuple[DataFrame, str]:
    """All columns of ``df`` and one struct column with the results, under a name that ``df`` hasn't."""
    name = "__made"
    while name in df.columns:
        name += "_"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    fields = StructType([StructField(f"r{i}", f.dataType, True) for i, f in enumerate(result.fields)])
    made = map_text(plain, f"c{df.columns.index(text)}", make, fields, plain.columns)
    old = [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    new = F.struct(*[F.col(f"r{i}").alias(f.name) for i, f in enumerate(result.fields)]).alias(name)
    return made.select(*old, new), name


def pack_texts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with its text as a Zstandard frame in column ``packed`` (null: null), for texts that cross the network to be compared."""
    keep = [c for c in rows.columns if c != text]

    def make():
        packer = zstandard.ZstdCompressor(level=3)
        return lambda column: [pa.array([None if t is None else packer.compress(t.encode()) for t in column.to_pylist()], pa.binary())]

    return map_text(rows, text, make, StructType([StructField("packed", BinaryType())]), keep)


def unpack_texts(column: pa.Array) -> pa.Array:
    """The string column that ``pack_texts`` packed."""
    unpacker = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else unpacker.decompress(z).decode() for z in column.to_pylist()], pa.large_string())
