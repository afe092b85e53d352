"""Rounding of report figures."""

from pyspark.sql import functions as F


def round_half_even(column, digits):
    """Scale, round half to even, scale back; stays in doubles."""
    scale = float(10 ** digits)
    return F.rint(column * scale) / scale
