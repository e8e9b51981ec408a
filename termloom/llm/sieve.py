"""A bounded bitmap that lets a table shed rows before a join moves it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)


def sieve(df: DataFrame, column: str, ids: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be among ``ids`` (one long column).

    No such row is ever lost; others pass at a rate that grows with the ids,
    so an exact join must follow.  The bitmap has at most ``most_bits`` (8 MB)
    whatever the number of ids; it is merged word by word in Spark and comes to
    the driver as two columns.
    """
    name = ids.columns[0]
    n = ids.count()
    bits = 1 << max(12, min(most_bits.bit_length() - 1, (16 * n).bit_length()))

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(_bit(x.to_numpy(), bits))

    at = ids.filter(F.col(name).isNotNull()).select(place(name).alias("b"))
    words = at.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 31))")).alias("m"))
    merged = words.toArrow()  # columns of at most 2**21 words, no row objects
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[merged.column("w").to_numpy()] = merged.column("m").to_numpy().astype(np.uint32)
    held = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_hold(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        b = _bit((x if known.all() else x.fillna(0)).to_numpy().astype(np.int64), bits)
        return pd.Series(known & ((held.value[b >> 5] >> (b & 31).astype(np.uint32)) & 1).astype(bool))

    return df.filter(may_hold(F.col(column)))
