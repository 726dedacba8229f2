"""Arrow UDFs that hold a few values at once, and what their workers remember, within bytes.

A batch from Spark holds thousands of whole texts, and what is made of them (words, spans, tokens, annotated pages) is
many times as large in Python. So a batch is cut into pieces, each piece's results leave before the next is begun, and a
worker's memory does not grow with the table.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes and rows of a piece; one value may be larger and is a piece then.
PIECE_BYTES, PIECE_ROWS = 256 << 10, 1024
#: Bytes, about, that one memory of a worker holds.
REMEMBERED_BYTES = 48 << 20


class Remembered(dict):
    """What a worker has worked out, by key, within some bytes: when half of them are full, the older half goes.

    make(key) gives what is not there yet; size(value) is a value's bytes, about. Keys of over `longest` characters are
    worked out each time.
    """

    def __init__(self, make: Callable[[str], object], size: Callable[[object], int], most: int = REMEMBERED_BYTES, longest: int = 64):
        super().__init__()
        self.make, self.size, self.most, self.longest = make, size, most, longest
        self.older: dict[str, object] = {}
        self.held = 0

    def __missing__(self, key: str) -> object:
        if len(key) > self.longest:
            return self.make(key)
        if (found := self.older.get(key)) is None:
            found = self.make(key)
        self.held += 200 + 2 * len(key) + self.size(found)
        if self.held > self.most // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        self[key] = found
        return found


def give_back() -> None:
    """Memory that Arrow and the C library hold unused goes back to the system; a worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def _sizes(values: pa.Array) -> np.ndarray:
    """Bytes of each value, nulls none."""
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_list(kind) and not pa.types.is_nested(kind.value_type):
        within = np.concatenate([[0], np.cumsum(_sizes(values.values))])
        offsets = values.offsets.to_numpy(zero_copy_only=False)
        return within[offsets[1:]] - within[offsets[:-1]]
    return np.full(len(values), values.nbytes // max(1, len(values)), dtype=np.int64)


def cuts(columns: tuple[pa.Array, ...], most: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[tuple[int, int]]:
    """(start, length) of pieces of some columns that have at most so many bytes and rows, or one row."""
    ends = np.cumsum(sum(_sizes(c) for c in columns))
    at, n = 0, len(columns[0])
    while at < n:
        before = int(ends[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows, n)
        yield at, end - at
        at = end


def text_fields(names: Iterable[str]) -> tuple[str, pa.DataType]:
    """Type and Arrow type of a struct of texts."""
    return "struct<" + ",".join(f"`{n}`:string" for n in names) + ">", pa.struct([(n, pa.string()) for n in names])


def _run(make: Callable[[], Callable[..., pa.Array]], batches: Iterator) -> Iterator[pa.Array]:
    gc.collect()  # memories of the task before may hold each other
    each = make()
    try:
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            for start, length in cuts(columns):
                yield each(*(c.slice(start, length) for c in columns))
            del columns
    finally:
        each = None
        gc.collect()
        give_back()


def _by_row(make: Callable[[], Callable[..., object]], arrow: pa.DataType, nulls: bool) -> Callable[[], Callable[..., pa.Array]]:
    """What makes a function of pieces of columns out of what makes one of a row's values."""

    def made() -> Callable[..., pa.Array]:
        each = make()
        return lambda *columns: pa.array([None if v[0] is None and not nulls else each(*v) for v in zip(*(c.to_pylist() for c in columns))], type=arrow)

    return made


def per_text(make: Callable[[], Callable[[str], object]], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """An Arrow UDF of a function of one value, made once in each task; null for null."""
    return per_piece(_by_row(make, arrow, False), kind)


def per_piece(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """The same of a function of a piece of a column, which sees nulls too."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _run(make, batches)

    return run


def per_row(make: Callable[[], Callable[..., object]], kind: str, arrow: pa.DataType) -> Callable[..., Column]:
    """The same of a function of the values of several columns, which sees nulls too."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from _run(_by_row(make, arrow, True), batches)

    return run
