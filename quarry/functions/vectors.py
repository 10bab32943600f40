"""Vectors as columns, and as matrices in tasks, computed in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hash_embedding(text: Column) -> Column:
    """A deterministic stand-in for an embedding model: the 32 bytes of SHA-256, each by 255."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def as_matrix(column: pa.Array) -> np.ndarray:
    """A row for each list of the column; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def as_unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length one; those without length stay 0."""
    size = np.linalg.norm(rows, axis=-1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
