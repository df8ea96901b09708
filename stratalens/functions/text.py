"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(text: Column) -> Column:
    """Shannon entropy of a string in bits per character; 0 for the empty string."""
    chars = F.split(text, "")
    chars = F.filter(chars, lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    found = F.aggregate(F.transform(F.array_distinct(chars), lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.length(text) > 0, found).otherwise(0.0)


def bar(n: Column, total: Column, width: int = 20) -> Column:
    return F.when(total > 0, F.repeat(F.lit("#"), F.bround(n * width / total).cast("int"))).otherwise("")
