"""Vectors as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero or missing."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def from_blob(blob: Column) -> Column:
    """array<float> of a binary of little-endian 32-bit floats; null stays null."""

    @F.pandas_udf("array<float>")
    def read(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return read(blob)
