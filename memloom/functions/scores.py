"""Score coercions of judges' replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(score: Column) -> Column:
    """A number from 0 to 1 with four places; anything that is no number is 0."""
    x = F.coalesce(score.try_cast("double"), F.lit(0.0))
    x = F.when(F.isnan(x), F.lit(0.0)).otherwise(x)
    return F.round(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), 4)


def trilevel(score: Column) -> Column:
    x = F.coalesce(score.try_cast("double"), F.lit(0.0))
    return F.when(x <= 0.25, F.lit(0.0)).when(x < 0.75, F.lit(0.5)).otherwise(F.lit(1.0))


def binary(score: Column) -> Column:
    return F.when(F.lower(F.trim(score)).isin("1", "1.0", "true"), 1).otherwise(0)
