"""Unicode normal forms and sequence similarity: what column expressions can't say, as Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())  # a type, not its name: importing needs no session
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility forms and widths made one."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())  # a type, not its name: importing needs no session
def strip_accents(text: pd.Series) -> pd.Series:
    """Letters without their combining marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching blocks over both lengths, from 0 to 1."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
