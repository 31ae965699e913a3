"""How far two coverage masks are apart, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error(a: Column, b: Column) -> Column:
    """struct<rmse, worst> of two arrays of numbers of one length: the root mean square and the largest of their differences; null for empty or null ones."""
    apart = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    zero = F.lit(0.0)
    sums = F.aggregate(apart, F.struct(zero.alias("s"), zero.alias("w")), lambda t, d: F.struct((t["s"] + d * d).alias("s"), F.greatest(t["w"], F.abs(d)).alias("w")))
    return F.when(F.size(a) > 0, F.struct(F.sqrt(sums["s"] / F.size(a)).alias("rmse"), sums["w"].alias("worst")))
