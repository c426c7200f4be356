"""Vectors as texts: base64 of little-endian 32-bit floats."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


@F.pandas_udf(StringType())
def encode_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, dtype="<f4").tobytes()).decode())


def _floats(text: str | None) -> np.ndarray | None:
    """Null for a text that is no base64, or whose bytes are no floats."""
    try:
        return None if text is None else np.frombuffer(base64.b64decode(text, validate=True), dtype="<f4")
    except ValueError:
        return None


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(_floats)
