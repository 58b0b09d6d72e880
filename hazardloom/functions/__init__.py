"""Column functions."""

from hazardloom.functions.scalars import (
    elapsed_days,
    hash_order,
    missing,
    month_name,
    nan_to_null,
    number_or_zero,
    sigmoid,
    whole_days,
)
from hazardloom.functions.curves import expected_time, linear_hazards, rounded_curve, survival_curve

__all__ = [
    "elapsed_days", "expected_time", "hash_order", "linear_hazards", "missing", "month_name", "nan_to_null", "number_or_zero",
    "rounded_curve", "sigmoid", "survival_curve", "whole_days",
]
