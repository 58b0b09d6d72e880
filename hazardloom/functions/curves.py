"""Survival curves on a time grid.

A curve is one array per row, so the row count stays n instead of n x 159 and nothing is shuffled. The arrays are
filled by Arrow functions on whole column batches: the equivalent higher-order ``aggregate`` copies its growing array at
every step (159^2/2 copies per row) and measured eight times slower.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARRAY = T.ArrayType(T.DoubleType())
SLICE = 1000  # rows of a batch computed at once, which bounds what a worker holds besides its batch

# the batch functions travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def as_numpy(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The values; missing ones are NaN. ``to_numpy`` loads pandas, 47 MB in every worker, so numbers without missing ones go by DLPack."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    plain = not values.null_count and (pa.types.is_integer(values.type) or pa.types.is_floating(values.type))
    return np.from_dlpack(values) if plain else values.to_numpy(zero_copy_only=False)


def as_arrow(values: np.ndarray) -> pa.Array:
    """Numbers as they lie in memory; ``pa.array`` would load pandas."""
    return pa.Array.from_buffers(pa.from_numpy_dtype(values.dtype), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))])


def as_matrix(arrays: pa.Array, width: int) -> np.ndarray:
    return as_numpy(arrays.flatten()).reshape(len(arrays), width)


def as_arrays(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(as_arrow(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), as_arrow(matrix.ravel()))


def slices(rows: int) -> list[slice]:
    return [slice(at, min(rows, at + SLICE)) for at in range(0, rows, SLICE)]


def linear_fill(time_weight: float, times) -> Callable[[pa.Array], np.ndarray]:
    """The function from scores to h(t) = sigmoid(score + time_weight * t) for every t of the grid."""
    drift = float(time_weight) * np.asarray(times, dtype=float)

    def hazards(score: pa.Array) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-(as_numpy(score)[:, None] + drift[None, :])))

    return hazards


def linear_hazards(score: Column, time_weight: float, times) -> Column:
    """h(t) = sigmoid(score + time_weight * t) for every t of the grid."""
    fill, width = linear_fill(time_weight, times), len(times)

    @F.arrow_udf(_ARRAY)
    def hazards(score: pa.Array) -> pa.Array:
        out = np.empty((len(score), width))
        for at in slices(len(out)):
            out[at] = fill(score[at])
        return as_arrays(out)

    return hazards(score)


def survival(hazards: np.ndarray) -> np.ndarray:
    return np.exp(-np.cumsum(hazards, axis=1))


def survival_curve(hazards: Column, steps: int) -> Column:
    """S(t_k) = exp(-(h(t_1) + ... + h(t_k)))."""

    @F.arrow_udf(_ARRAY)
    def survive(hazards: pa.Array) -> pa.Array:
        h = as_matrix(hazards, steps)
        out = np.empty(h.shape)
        for at in slices(len(h)):
            out[at] = survival(h[at])
        return as_arrays(out)

    return survive(hazards)


def fillable(curves: DataFrame, rows: DataFrame, hazards: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``curves``, with a note that its ``surv`` follows by ``hazards`` from the column ``surv`` of ``rows``, which are the same rows.

    Who reads the curves once can then compute them where they are read, in one worker of a task instead of two. Anything made from ``curves``
    has no such note and reads the column.
    """
    curves._filled_from = rows, hazards
    return curves


def curve_source(curves: DataFrame) -> tuple[DataFrame, Callable[[pa.Array], np.ndarray]] | None:
    """What ``fillable`` noted: rows, and the function from their column ``surv`` to curves."""
    noted = vars(curves).get("_filled_from")
    if noted is None:
        return None
    rows, hazards = noted
    return rows, lambda column: survival(hazards(column))


def expected_time(curve: Column, times) -> Column:
    """Area under the curve over the grid, by trapezoids."""
    grid = np.asarray(times, dtype=float)

    @F.arrow_udf(T.DoubleType())
    def area(curve: pa.Array) -> pa.Array:
        return as_arrow(np.trapezoid(as_matrix(curve, len(grid)), x=grid, axis=1))

    return area(curve)


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Each value rounded as Spark's ``round`` does: half away from zero, by the shortest decimal that reads back as the value."""
    unit = 10.0**digits
    scaled = np.abs(values) * unit
    low = np.floor(scaled)
    part = scaled - low
    out = np.copysign((low + (part >= 0.5)) / unit, values)
    # the product is not exact: values near a half, and large ones, are decided on their decimals
    for i in np.argwhere((np.abs(part - 0.5) < 1e-6) | ~(scaled < 1e9)):
        v = values[tuple(i)]
        if np.isfinite(v):
            out[tuple(i)] = float(Decimal(repr(float(v))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))
        else:
            out[tuple(i)] = v
    return out


def rounded_curve(curve: Column, steps: int, digits: int) -> Column:
    """The curve with every point rounded as by ``round``, without a decimal per point."""

    @F.arrow_udf(_ARRAY)
    def rounded(curve: pa.Array) -> pa.Array:
        s = as_matrix(curve, steps)
        out = np.empty(s.shape)
        for at in slices(len(s)):
            out[at] = half_up(s[at], digits) + 0.0
        return as_arrays(out)

    return rounded(curve)
