"""Weighted counts of ordered pairs inside one bounded bucket, for use in a task."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from hazardloom.functions.curves import as_numpy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMB, CHUNK = 21, 1 << 20  # products of 21-bit parts stay below 2^42, so sums over a chunk stay below 2^62


def exact_dot(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of products of two arrays of non-negative 64-bit integers, exact at any size."""
    total, mask = 0, (1 << LIMB) - 1
    for at in range(0, len(a), CHUNK):
        x, y = a[at : at + CHUNK], b[at : at + CHUNK]
        for i in range(3):
            for j in range(3):
                total += int(((x >> (LIMB * i)) & mask) @ ((y >> (LIMB * j)) & mask)) << (LIMB * (i + j))
    return total


def ordered_pairs(code: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[int, int]:
    """Over all pairs with code_i even and code_i < code_j: weight of those with value_i < value_j, and with equal values.

    Codes are compared bit by bit: a pair is decided at the highest bit that differs. Per bit, one sort by (cell, value)
    and running sums give every left member the weight of the right members above and beside it.
    """
    by_value = np.argsort(-value, kind="stable")
    code, value, weight = code[by_value], value[by_value], weight[by_value]
    rank = np.unique(code, return_inverse=True)[1]
    even, place = code % 2 == 0, np.arange(len(code))
    above_sum = beside_sum = 0
    for bit in range(int(rank.max()).bit_length()):
        at = np.argsort(rank >> (bit + 1), kind="stable")
        cell, v, w = rank[at] >> (bit + 1), value[at], weight[at]
        right = (rank[at] >> bit) & 1 == 1
        left = np.where(~right & even[at], w, 0)
        seen = np.concatenate([[0], np.cumsum(np.where(right, w, 0))])
        new_cell = np.concatenate([[True], cell[1:] != cell[:-1]])
        new_value = new_cell | np.concatenate([[True], v[1:] != v[:-1]])
        starts = np.flatnonzero(new_value)
        group = np.cumsum(new_value) - 1
        first, last = seen[starts][group], seen[np.append(starts[1:], len(code))][group]
        cell_first = seen[np.maximum.accumulate(np.where(new_cell, place, 0))]
        above_sum += exact_dot(left, first - cell_first)
        beside_sum += exact_dot(left, last - first)
    return above_sum, beside_sum


_EXACT = pa.decimal128(38, 0)


def _codes(points: pa.Table) -> np.ndarray:
    """Outcomes (d, e) as whole numbers in their order, events even."""
    d, e = (as_numpy(points.column(x)) for x in ("d", "e"))
    return np.unique(d, return_inverse=True)[1] * 2 + e


def _one_row(**counts: int) -> pa.Table:
    exact = {name: pa.py_buffer(x.to_bytes(16, "little")) for name, x in counts.items()}
    return pa.table({name: pa.Array.from_buffers(_EXACT, 1, [None, x]) for name, x in exact.items()})


def bucket_counts(points: pa.Table) -> pa.Table:
    """One row (concordant, tied) for the points (d, e, p, n) of a range of the prediction."""
    above, beside = ordered_pairs(_codes(points), as_numpy(points.column("p")), as_numpy(points.column("n")))
    return _one_row(concordant=above, tied=beside)


def span_counts(cells: pa.Table) -> pa.Table:
    """One row (pairs, concordant) for the cells (d, e, b, n) of a range of the outcome: all pairs, and those whose ranges ``b`` ascend."""
    code, n = _codes(cells), as_numpy(cells.column("n"))
    above, _ = ordered_pairs(code, as_numpy(cells.column("b")), n)
    at = np.argsort(code, kind="stable")
    code, n = code[at], n[at]
    later = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])[np.searchsorted(code, code, side="right")]
    return _one_row(pairs=exact_dot(np.where(code % 2 == 0, n, 0), later), concordant=above)
