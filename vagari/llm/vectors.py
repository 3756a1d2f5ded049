"""Reading embedding columns from Arrow: rows as one matrix, and which rows are usable."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of the commonest length as float64, usable, dimensions).

    Rows that are null or hold null or non-finite components aren't usable and
    are zeros. So are rows whose length differs from the longest one in this
    column; callers compare only rows of equal length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    sizes = np.zeros(n, np.int64)
    present = np.asarray(column.is_valid())
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes[:] = lengths
    dims = int(sizes.max()) if n else 0
    flat = column.flatten().cast(pa.float64())
    bad = np.asarray(flat.is_null())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((n, dims))
    ok = present & (sizes == dims) & (sizes > 0)
    starts = np.concatenate(([0], np.cumsum(np.where(present, sizes, 0))[:-1]))
    if ok.any():
        take = starts[ok][:, None] + np.arange(dims)
        got, null = values[take], bad[take].any(axis=1)
        usable = np.isfinite(got).all(axis=1) & ~null
        got[~usable] = 0
        out[ok] = got
        ok[np.flatnonzero(ok)] = usable
    return out, ok, dims
