"""What the operators on whole texts share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.core.session import cut

#: Bytes of text that a worker turns into Python objects at a time.
SLICE_BYTES = 1 << 21
#: So many keys of a few dozen bytes may be broadcast; more meet their rows by a shuffle.
BROADCAST_KEYS = 400_000
#: A key of more than one in so many rows is heavy, so there are fewer heavy keys than this.
HEAVY = 1000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def few(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A table of keys, computed once; with a hint to broadcast it only where its rows were counted to be few."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def labelled(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined to ``known``, which has one row a key.

    Rows of heavy keys stay where they are and get theirs by a broadcast of fewer than ``HEAVY``
    rows; the others are joined by a shuffle, so no task gets all rows of a group of copies.
    """
    total = rows.count()
    heavy = F.broadcast(cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") * HEAVY > total).select(key)))
    near = rows.join(heavy, key, "left_semi").join(F.broadcast(known.join(heavy, key, "left_semi")), key, "left")
    return near.union(rows.join(heavy, key, "left_anti").join(known, key, "left"))


def as_bytes(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column that hold about ``budget`` bytes each (one row at least)."""
    if not len(column):
        return
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64))
    ends = np.cumsum(sizes)
    start = 0
    while start < len(column):
        reach = (ends[start - 1] if start else 0) + budget
        stop = max(start + 1, int(np.searchsorted(ends, reach, side="right")))
        yield start, stop
        start = stop


def texts(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The first row and the UTF-8 texts of each slice; null is the empty text."""
    raw = as_bytes(column)
    for start, stop in slices(column, budget):
        yield start, [x or b"" for x in raw.slice(start, stop - start).to_pylist()]
