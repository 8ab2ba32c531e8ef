"""Scalar quantization of vectors: F32, F16, BF16, I8 and B1."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("F32", "F16", "BF16", "I8", "B1")


def name_of(name: str | None) -> str:
    return name.upper() if name and name.upper() in NAMES else "F32"


def metric_for(kind: str, quantization: str) -> str:
    """The metric that is computed: single bits have only HAMMING, and nothing else has it."""
    if quantization == "B1":
        return "HAMMING"
    if kind == "HAMMING":
        raise ValueError("HAMMING needs B1 quantization")
    return kind


def i8(v: Column) -> Column:
    """round(127 x) within -127 and 127; distances are those of these integers."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127).cast("int"))))


def b1(v: Column) -> Column:
    """The signs as bytes, lowest bit first."""

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else np.packbits(np.nan_to_num(np.asarray(r, np.float64)) > 0, bitorder="little").tobytes())

    return packed(v)


def f16(v: Column) -> Column:
    @F.pandas_udf("array<float>")
    def rounded(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else np.asarray(r, np.float32).astype(np.float16).astype(np.float32))

    return rounded(v)


def bf16(v: Column) -> Column:
    """The upper 16 bits of single precision, to the nearest even."""

    def one(r):
        bits = np.asarray(r, np.float32).view(np.uint32)
        up = (bits + (np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1)))) & np.uint32(0xFFFF0000)
        return up.view(np.float32)

    @F.pandas_udf("array<float>")
    def rounded(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else one(r))

    return rounded(v)
