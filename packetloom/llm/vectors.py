"""Integer vectors: scaled components, and blocks of them as packed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers beyond it are taken as this bound, so that products of up to 1,024 of them stay whole in a long.
LARGEST = 1 << 26
EXACT = 1 << 53  # up to here doubles hold every integer


def is_finite(vector: Column) -> Column:
    """False for null, and for vectors with a null or non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x, computed in doubles."""
    bound = float(LARGEST)
    return F.transform(
        vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * float(scale), F.lit(bound)), F.lit(-bound))).cast("int")
    )


def pack(values: np.ndarray) -> bytes:
    """Integers in the narrowest width that holds all of them; the width is the first byte."""
    values = np.asarray(values)
    most = max(int(values.max()), -int(values.min()) - 1) if values.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of one matrix; shorter lists end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if not len(lengths):
        return np.zeros((0, 0), np.int64)
    out = np.zeros((len(lengths), int(lengths.max())), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two integer matrices, as integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = width * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def numbered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of at most `size` rows with numbers that no other task gives."""
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield number, batch.slice(at, size)
            number += 1
