"""Hilbert codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 16


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of each row of axes (n rows, d coordinates below 2**bits), as int64.

    The coordinates are turned into the transposed index by undoing the curve's reflections and
    exchanges from the highest bit down, then by a Gray decode; their bits are interleaved last.
    """
    x = [axes[:, i].astype(np.int64).copy() for i in range(axes.shape[1])]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[-1] & (1 << b), t ^ ((1 << b) - 1), t)
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for xi in x:
            code = (code << 1) | (((xi ^ t) >> b) & 1)
    return code


def hilbert_code(*axes: Column) -> Column:
    """Hilbert code of up to three integer columns, each below 2**16; nulls count as 0."""

    @F.pandas_udf("long")
    def code(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert(frame.fillna(0).to_numpy(dtype=np.int64)))

    return code(F.struct(*[F.coalesce(a.cast("int"), F.lit(0)).alias(f"a{i}") for i, a in enumerate(axes)]))
