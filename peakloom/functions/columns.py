"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rank_quantile(values: Column, q: float, how: str) -> Column:
    """Quantile of an array that is one of its values: "nearest" or "higher" rank."""
    at = (F.size(values) - 1) * F.lit(q)
    i = (F.rint(at) if how == "nearest" else F.ceil(at)).cast("int")
    return F.get(F.array_sort(values), i)


def log2_plus(c: Column) -> Column:
    return F.log2(F.greatest(c, F.lit(0.0)) + 1)


def normalised_name(name: str) -> str:
    """A given name, lower-cased and without spaces."""
    return name.lower().replace(" ", "")
