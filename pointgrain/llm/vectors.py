"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x); absolute values of x stay below LARGEST.
SCALE, LARGEST = 256, 1 << 19


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    cells = F.forall(F.col(f"`{vector}`"), lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(cells, F.lit(False))


def whole_numbers(column: pa.Array, length: int) -> np.ndarray:
    """An Arrow column of vectors as a matrix of whole numbers; shorter vectors end in zeros, longer ones are an error.
    Components whose absolute
    value reaches LARGEST are an error, so that sums of products fit in 64 bits."""
    sizes = np.diff(np.asarray(column.offsets))
    cells = np.floor(SCALE * column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    if len(cells) and np.abs(cells).max() >= SCALE * LARGEST:
        raise ValueError(f"a component's absolute value reaches {LARGEST}")
    if len(sizes) and sizes.max() > length:
        raise ValueError(f"a vector has more than {length} components")
    out = np.zeros((len(sizes), length), np.int64)
    out[np.arange(length) < sizes[:, None]] = cells.astype(np.int64)
    return out
