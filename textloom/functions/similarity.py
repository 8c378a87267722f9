"""Edit distance, likeness of texts, and the kernel over it. Lengths are in code points."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; 0 if either text is null or empty."""
    blank = (F.coalesce(F.length(a), F.lit(0)) == 0) | (F.coalesce(F.length(b), F.lit(0)) == 0)
    return F.when(blank, F.lit(0)).otherwise(F.levenshtein(a, b))


def normalized_distance(a: Column, b: Column) -> Column:
    """Distance over the longer length, in 32 bits; NaN for two empty texts, null if either is null."""
    longest = F.greatest(F.length(a), F.length(b))
    share = F.when(longest == 0, F.lit(float("nan"))).otherwise(distance(a, b) / F.nullif(longest, F.lit(0)))
    return F.when(a.isNotNull() & b.isNotNull(), share).cast("float")


def similarity(a: Column, b: Column) -> Column:
    """1 - normalized_distance, in 32 bits. An empty text and another one are alike (1)."""
    return (F.lit(1.0) - normalized_distance(a, b)).cast("float")


def gaussian_kernel(likeness: Column, t1: Column, t2: Column) -> Column:
    """t1 * exp(-likeness^2 / t2): falls with likeness."""
    return t1 * F.exp(-F.pow(likeness.cast("double"), F.lit(2.0)) / t2)


def bandwidths(n: Column, h: float) -> tuple[Column, Column]:
    """t1 = sqrt(2 pi) / (n - 1), infinite for n = 1; t2 = 2 h^2."""
    scale = math.sqrt(2 * math.pi)
    return F.when(n > 1, F.lit(scale) / F.nullif(n - 1, F.lit(0))).otherwise(F.lit(float("inf"))), F.lit(2 * h * h)
