"""Scalar helpers as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hamming_within(a: Column, b: Column, most: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= most


def split_any(text: Column, characters: str) -> Column:
    """Parts between any of ``characters``, trimmed, without a trailing empty one."""
    import re

    parts = F.transform(F.split(text, "[" + re.escape(characters) + "]"), lambda x: F.trim(x))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trimmed(text: Column, character: str = " ") -> Column:
    return F.btrim(text, F.lit(character))


def excel_1904(serial: Column) -> Column:
    """Timestamp of a spreadsheet serial in the 1904 system."""
    return F.timestamp_seconds((serial.cast("double") - 24107) * 86400)


def dotted_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("y.M.d"))


def epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


@F.pandas_udf(T.StringType())
def gbk(raw: pd.Series) -> pd.Series:
    """Text of GBK bytes; undecodable bytes become U+FFFD."""
    return raw.map(lambda b: None if b is None else bytes(b).decode("gbk", "replace"))
