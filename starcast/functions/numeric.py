"""Column arithmetic on stars and predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, HIGHEST = 1.0, 5.0


def clip(col: Column, low: float = LOWEST, high: float = HIGHEST) -> Column:
    """``col`` moved into ``[low, high]``; NULL stays NULL."""
    return F.when(col > high, F.lit(high)).when(col < low, F.lit(low)).otherwise(col)


def ensemble_mean(*predictions: Column) -> Column:
    total = predictions[0]
    for prediction in predictions[1:]:
        total = total + prediction
    return total / F.lit(float(len(predictions)))


def prediction_error(prediction: Column, stars: Column) -> Column:
    return prediction - stars


def half_stars(stars: Column) -> Column:
    """Stars as a whole number of half stars, so that sums do not depend on the order of rows."""
    doubled = stars.cast("double") * 2
    whole = F.round(doubled).cast("long")
    return F.when(doubled == whole, whole).when(
        doubled.isNotNull(),
        F.raise_error(F.concat(F.lit("stars are not a multiple of one half: "), stars.cast("string"))).cast("long"),
    )
