"""Comparing predictions with known ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcast.functions.numeric import prediction_error

KEYS = ["user_id", "business_id"]
EDGES = (0, 1, 2, 3, 4)


def join_truth(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every known rating with every prediction of its pair."""
    return truth.join(predictions, KEYS)


def matched_errors(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """As :func:`join_truth`, with equal rows counted in ``copies`` before the join instead of repeated by it."""
    known = truth.groupBy(*KEYS, "stars").agg(F.count(F.lit(1)).alias("known_copies"))
    scored = predictions.groupBy(*KEYS, "prediction").agg(F.count(F.lit(1)).alias("scored_copies"))
    # A key has one row for each of its values, so there is nothing to cut.
    matched = known.join(scored, KEYS)
    return matched.select(
        *KEYS, "stars", "prediction", (F.col("known_copies") * F.col("scored_copies")).alias("copies")
    )


def _diff() -> Column:
    return prediction_error(F.col("prediction"), F.col("stars"))


def _copies(joined: DataFrame) -> Column:
    return F.col("copies") if "copies" in joined.columns else F.lit(1)


def _total(value: Column, zero: float | int) -> Column:
    return F.coalesce(F.sum(value), F.lit(zero))


def signed_totals(joined: DataFrame) -> list[Column]:
    """Sum and count of predictions that are too high and too low; an exact one is neither."""
    diff, copies = _diff(), _copies(joined)
    return [
        _total(F.when(diff > 0, diff * copies), 0.0).alias("over_sum"),
        _total(F.when(diff > 0, copies), 0).cast("long").alias("over_count"),
        _total(F.when(diff < 0, diff * copies), 0.0).alias("under_sum"),
        _total(F.when(diff < 0, copies), 0).cast("long").alias("under_count"),
    ]


def rmse_column(joined: DataFrame) -> Column:
    diff, copies = _diff(), _copies(joined)
    return F.sqrt(F.try_divide(F.sum(diff * diff * copies), F.sum(F.when(diff.isNotNull(), copies)))).alias("rmse")


def bin_names(edges: Sequence[float] = EDGES) -> list[str]:
    return [f"{low}-{high}" for low, high in zip(edges, edges[1:])]


def bin_counts(joined: DataFrame, edges: Sequence[float] = EDGES, closed: str = "right") -> list[Column]:
    """One count per bin of absolute error. Right-closed bins include the lowest edge; values past the ends count
    nowhere."""
    if closed not in ("right", "left"):
        raise ValueError("closed must be 'right' or 'left'")
    size, copies = F.abs(_diff()), _copies(joined)
    counts = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        if closed == "left":
            inside = (size >= low) & (size < high)
        else:
            inside = ((size >= low) if i == 0 else (size > low)) & (size <= high)
        counts.append(_total(F.when(inside, copies), 0).cast("long").alias(f"{low}-{high}"))
    return counts


def signed_error_totals(joined: DataFrame) -> DataFrame:
    return joined.agg(*signed_totals(joined))


def rmse(joined: DataFrame) -> DataFrame:
    return joined.agg(rmse_column(joined))


def error_histogram(joined: DataFrame, edges: Sequence[float] = EDGES, closed: str = "right") -> DataFrame:
    """``bin, count`` by falling count, empty bins included; no rows if every bin is empty."""
    names = bin_names(edges)
    counted = joined.agg(*bin_counts(joined, edges, closed))
    some = F.greatest(*[F.col(f"`{name}`") for name in names], F.lit(0)) > 0
    columns = [F.col(f"`{name}`") for name in names]
    return counted.where(some).unpivot([], columns, "bin", "count").orderBy(F.desc("count"), "bin")
