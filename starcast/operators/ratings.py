"""Aggregates over the training ratings.

Everything here is a grouped aggregate with a map-side partial step, so a key that holds most of the rows reaches the
shuffle as one partial row per task. No operator builds an array per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starcast.functions.numeric import half_stars


def _last_stars(order_cols: Sequence[str], stars: Column) -> Column:
    """Stars of the last row in the order; equal positions, or no order at all, fall to the higher rating."""
    if not order_cols:
        return F.max(stars)
    return F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)], stars.alias("s")))["s"]


def latest_rating(ratings: DataFrame, order_cols: Sequence[str] = ()) -> DataFrame:
    """One rating per user and business: the last in the declared order."""
    return ratings.groupBy("user_id", "business_id").agg(_last_stars(order_cols, F.col("stars")).alias("stars"))


def rating_facts(ratings: DataFrame, order_cols: Sequence[str] = ()) -> DataFrame:
    """One row per user and business: the last rating in half stars, and count and sum of all its rows."""
    halves = ratings.withColumn("__half", half_stars(F.col("stars")))
    return halves.groupBy("user_id", "business_id").agg(
        _last_stars(order_cols, F.col("__half")).alias("half"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("__half").alias("row_halves"),
    )


def business_facts(facts: DataFrame) -> DataFrame:
    """Per business: raters, sum of their last ratings, and count and sum over all rows."""
    return facts.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("raters"),
        F.sum("half").alias("halves"),
        F.sum("rows").alias("rows"),
        F.sum("row_halves").alias("row_halves"),
    )


def user_facts(facts: DataFrame) -> DataFrame:
    """Per user: rated businesses and the sum of their last ratings."""
    return facts.groupBy("user_id").agg(F.count(F.lit(1)).alias("rated"), F.sum("half").alias("halves"))


def business_mean(ratings: DataFrame) -> DataFrame:
    """Mean over all rows of a business, repeated ratings included."""
    return ratings.groupBy("business_id").agg(F.avg("stars").alias("mean_stars"))


def cold_user_mean(latest: DataFrame) -> DataFrame:
    """What a user without history gets: the mean of the business's last ratings."""
    return latest.groupBy("business_id").agg(F.avg("stars").alias("mean_stars"))


def cold_business_mean(latest: DataFrame) -> DataFrame:
    """What a business without history gets: the mean of the user's last ratings."""
    return latest.groupBy("user_id").agg(F.avg("stars").alias("mean_stars"))


def global_mean(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.avg("stars").alias("mean_stars"))


def ratings_by_business(ratings: DataFrame) -> DataFrame:
    """Ratings keyed by business. A list per business would have no size bound, so the key stays a column."""
    return ratings.select("business_id", "user_id", "stars")


def ratings_by_user(ratings: DataFrame) -> DataFrame:
    return ratings.select("user_id", "business_id", "stars")


def raters_by_business(ratings: DataFrame) -> DataFrame:
    """The set of raters of each business, one row per member."""
    return ratings.select("business_id", "user_id").distinct()


def column_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the mean of the values of each column that are neither NULL nor NaN."""
    return df.agg(*[F.expr(f"avg(nanvl(cast(`{c}` as double), cast(null as double))) as `{c}`") for c in cols])
