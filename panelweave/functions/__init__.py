"""Scalar functions that Spark has no built-in for."""

from .stats import bh_adjust, bh_adjust_large, format_number, normal_p_value

__all__ = ["bh_adjust", "bh_adjust_large", "format_number", "normal_p_value"]
