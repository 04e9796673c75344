"""A stable hash of ids to [0, 1), the same on every machine and in every session."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """SplitMix64, a public generator, of 64-bit integers; wraps around as it defines."""
    # Fixed values of the generator.
    gamma, first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    with np.errstate(over="ignore"):
        z = values.astype(np.int64).view(np.uint64) + gamma * np.uint64(salt + 1)
        z = (z ^ (z >> np.uint64(30))) * first
        z = (z ^ (z >> np.uint64(27))) * second
    return z ^ (z >> np.uint64(31))


def unit_hash(column: Column, kind: T.DataType, salt: int = 0) -> Column:
    """Integers by SplitMix64, all else by the CRC-32 of its string; as Arrow batches."""
    if isinstance(kind, T.IntegralType):

        @F.pandas_udf("double")
        def of_int(v: pd.Series) -> pd.Series:
            return pd.Series((split_mix(v.fillna(0).to_numpy(), salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53)).where(v.notna().to_numpy())

        return of_int(column.cast("long"))

    @F.pandas_udf("double")
    def of_text(v: pd.Series) -> pd.Series:
        return v.map(lambda s: None if s is None else zlib.crc32(s.encode(), salt) / float(1 << 32))

    return of_text(column.cast("string"))
