"""Vector functions: distances as Columns, vector text, dimension checks,
and the NumPy kernel used inside Arrow batches.

Metrics (contract S1 and extension X8):
  ``l2``          Euclidean distance, ascending (relational engine)
  ``l2_squared``  squared Euclidean, ascending (flat index / collection)
  ``ip``          inner product, descending (declared but unused upstream)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "l2_squared", "ip")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")
    return metric


def _as_col(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    # a literal vector (single query): one array literal, no join needed
    return F.array(*[F.lit(float(x)).cast("double") for x in v])


def squared_l2(a, b) -> Column:
    """sum((a_i - b_i)^2) in DOUBLE."""
    return F.aggregate(
        F.zip_with(_as_col(a), _as_col(b),
                   lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def inner_product(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_as_col(a), _as_col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def distance(metric: str, a, b) -> Column:
    """Score column for ``metric``; for ``ip`` larger is better."""
    check_metric(metric)
    if metric == "l2":
        return l2(a, b)
    if metric == "l2_squared":
        return squared_l2(a, b)
    return inner_product(a, b)


def order_ascending(metric: str) -> bool:
    return check_metric(metric) != "ip"


def vector_to_text(v) -> Column:
    """``[a,b,...]`` text form of a vector (the relational wire format)."""
    return F.concat(F.lit("["), F.array_join(F.transform(_as_col(v), lambda x: x.cast("string")), ","),
                    F.lit("]"))


def parse_vector_text(txt) -> Column:
    """``'[a,b,...]'`` -> ARRAY<FLOAT> (strip brackets, split on commas)."""
    c = _as_col(txt)
    return F.split(F.regexp_replace(F.trim(c), r"^\[|\]$", ""), r"\s*,\s*").cast("array<float>")


def dimension_ok(v, dim: int) -> Column:
    return F.size(_as_col(v)) == F.lit(int(dim))


# ---------------------------------------------------------------------------
# NumPy kernel for Arrow batches (mapInArrow paths)
# ---------------------------------------------------------------------------

def arrow_matrix(arr: pa.Array, dim: int) -> np.ndarray:
    """A list<float> Arrow column as an (n, dim) float64 matrix without a
    Python loop. Rows of the wrong size raise (checked upstream by B12)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, dim), dtype=np.float64)
    if arr.null_count:
        raise ValueError("NULL vector in batch")
    offsets = arr.offsets.to_numpy()
    flat = arr.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    if flat.size != n * dim or not np.all(np.diff(offsets) == dim):
        raise ValueError(f"vector of wrong dimension in batch (expected {dim})")
    return flat.reshape(n, dim).astype(np.float64, copy=False)


def pair_scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Exact scores for row pairs ``x[i]`` / ``q[i]`` (same shape)."""
    if metric == "ip":
        return np.einsum("ij,ij->i", x, q)
    diff = x - q
    sq = np.einsum("ij,ij->i", diff, diff)
    return np.sqrt(sq) if metric == "l2" else sq


def block_scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Approximate (GEMM) scores for all pairs, shape (len(x), len(q)); used
    only to pick candidates, which are then scored exactly."""
    dots = x @ q.T
    if metric == "ip":
        return dots
    xx = np.einsum("ij,ij->i", x, x)[:, None]
    qq = np.einsum("ij,ij->i", q, q)[None, :]
    return np.maximum(xx + qq - 2.0 * dots, 0.0)
