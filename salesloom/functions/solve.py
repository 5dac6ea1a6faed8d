"""Small least-squares solves on aggregated rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.pandas_udf(ArrayType(DoubleType()))
def solve_normal(xx: pd.Series, xy: pd.Series) -> pd.Series:
    """Minimum-norm solution of the normal equations ``XX b = xy``, one small system per row.

    ``xx`` is a flattened square matrix of centred second moments, ``xy`` the matching vector.
    A singular matrix (a category absent from the rows) still has its minimum-norm solution.
    """
    def usable(m, v) -> bool:
        return m is not None and v is not None and np.isfinite(m).all() and np.isfinite(v).all()

    pairs = [(np.asarray(m, dtype=float), np.asarray(v, dtype=float)) if usable(m, v) else None for m, v in zip(xx, xy)]
    out: list = [None] * len(pairs)
    # systems of one size are solved together
    for size in {len(p[1]) for p in pairs if p}:
        at = [k for k, p in enumerate(pairs) if p and len(p[1]) == size]
        m = np.stack([pairs[k][0] for k in at]).reshape(-1, size, size)
        v = np.stack([pairs[k][1] for k in at])
        # relative cut-off at rounding level: directions without any variance get weight zero
        for k, b in zip(at, np.matmul(np.linalg.pinv(m, rcond=1e-12, hermitian=True), v[:, :, None])[:, :, 0]):
            out[k] = b
    return pd.Series(out)
