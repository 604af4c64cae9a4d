"""One-bit codes of randomly rotated vectors, with correction factors and unbiased inner-product estimates.

For a unit vector o and a random rotation P, the code is the signs of P o; x = signs / sqrt(D) is a unit vector, and
<x, P q> / <x, P o> estimates <o, q> without bias for any unit q, with an error of about
sqrt((1 - f^2) / f^2) / sqrt(D - 1) per standard deviation, f = <x, P o> being the stored factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotation(dim: int, seed: int, bits: int = 0) -> np.ndarray:
    """A random rotation of vectors padded with zeros to a multiple of 64, or to more ``bits`` for finer codes."""
    size = -(-max(dim, bits) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return (q * np.sign(np.diag(r)))[:dim].astype(np.float64)  # [dim, size]: vectors are rows


def encode(unit: np.ndarray, turn: np.ndarray):
    """Packed signs (n, D / 8) and factors (n) of unit rows; a zero row has factor 0."""
    y = unit @ turn
    signs = y > 0
    factor = np.abs(y).sum(1) / np.sqrt(y.shape[1])
    return np.packbits(signs, axis=1), factor.astype(np.float32)


def signs(codes: np.ndarray) -> np.ndarray:
    """+1 / -1 rows of packed codes, scaled to unit length."""
    bits = np.unpackbits(codes, axis=1).astype(np.float32)
    return (bits * 2 - 1) / np.float32(np.sqrt(bits.shape[1]))


def error(factor: np.ndarray, size: int, deviations: float) -> np.ndarray:
    """How far an estimate of an inner product of unit vectors may be off, at that many standard deviations."""
    f = np.maximum(factor.astype(np.float64), 1e-6)
    return deviations * np.sqrt(np.maximum(1 - f**2, 0)) / f / np.sqrt(max(size - 1, 1))


def usable(column: str = "embedding") -> Column:
    """Vectors that take part: not null, not empty, only finite components and one that isn't zero."""
    c = F.col(column)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return c.isNotNull() & F.coalesce(F.forall(c, finite) & F.exists(c, lambda x: x != 0), F.lit(False))


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The commonest length of the usable vectors (the smaller on ties); others take no part. 0 for none."""
    top = vectors.where(usable(column)).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return top[0]["d"] if top else 0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of ``dim`` numbers a row as float64."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
