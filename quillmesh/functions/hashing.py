"""A 64-bit text hash over UTF-16 units, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M32 = np.uint64(0xFFFFFFFF)
#: The hash's seeds and multipliers.
SEEDS = (0xDEADBEEF, 0x41C6CE57)
FACTORS = (2654435761, 1597334677)
FINAL = (2246822507, 3266489909)


def hash_texts(texts: list[str | None]) -> list[str]:
    """All texts advance together, one UTF-16 unit a step, longest first."""
    units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), "<u2") for t in texts]
    sizes = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    lanes = [(np.uint64(seed) ^ sizes[order].astype(np.uint64)) & _M32 for seed in SEEDS]
    flat = np.concatenate(units).astype(np.uint64) if len(units) else np.empty(0, np.uint64)
    begin = (np.cumsum(sizes) - sizes)[order]
    ordered = sizes[order]
    for step in range(int(ordered[0]) if len(ordered) else 0):
        live = int(np.searchsorted(-ordered, -step, side="left"))
        code = flat[begin[:live] + step]
        for lane, factor in zip(lanes, FACTORS, strict=True):
            lane[:live] = ((lane[:live] ^ code) * np.uint64(factor)) & _M32
    a, b = lanes
    times = lambda x, k: (x * np.uint64(k)) & _M32
    a = times(a ^ (a >> np.uint64(16)), FINAL[0]) ^ times(b ^ (b >> np.uint64(13)), FINAL[1])
    b = times(b ^ (b >> np.uint64(16)), FINAL[0]) ^ times(a ^ (a >> np.uint64(13)), FINAL[1])
    out = [""] * len(texts)
    for place, x, y in zip(order, b, a, strict=True):
        out[place] = f"{int(x):08x}{int(y):08x}"
    return out


def stable_hash(text: Column) -> Column:
    """The hash as a column, by Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(hash_texts(texts.tolist()))

    return F.pandas_udf(run, T.StringType())(text)
