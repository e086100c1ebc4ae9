"""Functions of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, places: int) -> Column:
    """A double to so many decimals, as SQL engines do that scale it: times a power of ten, to the nearest whole number (halves away from zero), and back. A small
    negative value becomes -0.0, which prints as such; F.round makes it 0.0."""
    scaled = (F.col(value) if isinstance(value, str) else value).cast("double") * (10.0**places)
    return F.round(F.abs(scaled), 0) * F.signum(scaled) / (10.0**places)
