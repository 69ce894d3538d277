"""Vectors as arrays of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """In [-1, 1]; 0 where a vector is zero."""
    n = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n)))


def unit(a: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def dense(entries: Column, place: str, value: str, size: int) -> Column:
    """An array of numbers from structs sorted by place, zero where there is none: the gaps between them are filled."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<double>").alias("v"))

    def step(acc, e):
        filled = F.concat(acc["v"], zeros(e[place] - acc["next"]), F.array(e[value].cast("double")))
        return F.struct((e[place] + 1).cast("long").alias("next"), filled.alias("v"))

    return F.aggregate(entries, start, step, lambda acc: F.concat(acc["v"], zeros(F.lit(size) - acc["next"])))


def pack_fp16(a: Column) -> Column:
    """A vector as half-precision bytes, little end first; a batch at a time."""

    def pack(vectors: pd.Series) -> pd.Series:
        sizes = [0 if v is None else len(v) for v in vectors]
        flat = np.concatenate([np.asarray(v, np.float32) for v in vectors if v is not None] or [np.zeros(0, np.float32)]).astype("<f2").tobytes()
        ends = 2 * np.cumsum(sizes)
        return pd.Series([None if v is None else flat[e - 2 * n : e] for v, n, e in zip(vectors, sizes, ends, strict=True)])

    return F.pandas_udf(pack, BinaryType())(a)


def unpack_fp16(packed: Column) -> Column:
    """The vector of half-precision bytes."""

    def unpack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))

    return F.pandas_udf(unpack, ArrayType(FloatType()))(packed)
