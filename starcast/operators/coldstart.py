"""Predictions for pairs whose user or business has no entity row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.operators.skew import HeavyKeys, lookup_join


def cold_start_prediction(
    pairs: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    mean_stars: float,
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
) -> DataFrame:
    """The user's average if there is a user row, else the business's stars, else ``mean_stars``. Not clipped."""
    user_stars = users.select("user_id", "average_stars", F.lit(True).alias("__user"))
    business_stars = businesses.select(
        "business_id", F.col("stars").alias("business_stars"), F.lit(True).alias("__business")
    )
    found = lookup_join(pairs, user_stars, ["user_id"], "left", heavy_users)
    found = lookup_join(found, business_stars, ["business_id"], "left", heavy_businesses)
    prediction = (
        F.when(F.col("__user"), F.col("average_stars"))
        .when(F.col("__business"), F.col("business_stars"))
        .otherwise(F.lit(mean_stars))
    )
    return found.select("user_id", "business_id", prediction.cast("double").alias("prediction"))


def append_predictions(known: DataFrame, cold: DataFrame) -> DataFrame:
    columns = ["user_id", "business_id", "prediction"]
    return known.select(*columns).unionByName(cold.select(*columns))
