"""What the two vector operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector has components, all finite and not all zero."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches, one at a time."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if key != current and held:
                yield pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def basis(d: int, many: int, seed: int) -> np.ndarray:
    """``many`` one-dimensional projections, orthonormal within each run of ``d``."""
    rng = np.random.default_rng([seed, d])
    parts = []
    for _ in range(-(-many // d)):
        q, r = np.linalg.qr(rng.standard_normal((d, d)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate([p.T for p in parts])[:many]


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows ``(id, v)`` that can take part, ``v`` as stored."""
    return table.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("v")
    )
