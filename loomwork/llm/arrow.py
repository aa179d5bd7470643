"""Rows of Arrow batches as Python values, with texts as bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def rows(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Tuples of the columns; columns of strings come as bytes."""
    for b in batches:
        got = []
        for c in columns:
            x = b.column(b.schema.get_field_index(c))
            got.append(as_bytes(x) if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x.to_pylist())
        yield from zip(*got, strict=True)


def in_small_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """``df``, in a session whose batches to Python hold at most ``size``, unless the user has chosen a size.

    By default ten thousand rows make a batch, which are a hundred megabytes of texts for each task, in the JVM and in Python.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES, None) in ("67108864b", "64m"):
        conf.set(_BYTES, size)
    return df
