"""Association and similarity scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def npmi(px: Column, py: Column, pxy: Column) -> Column:
    """Normalised pointwise mutual information by natural logarithms; null where ``pxy`` is 1 or a share is missing."""
    return F.try_divide(F.ln(pxy / (px * py)), -F.ln(pxy))


def npmi_of_counts(cx: Column, cy: Column, cxy: Column, total: Column) -> Column:
    """The same from counts over one total; 0 where a count is unknown."""
    return F.coalesce(npmi(cx / total, cy / total, cxy / total), F.lit(0.0))


def overall(semantic: Column, ortho: Column, abbr: Column, ratio: float = 1.0) -> Column:
    """Semantic similarity and the better of both spelling distances, weighted ratio to 1."""
    return (F.lit(ratio) * semantic + F.lit(1.0) - F.least(ortho, abbr)) / F.lit(ratio + 1.0)
