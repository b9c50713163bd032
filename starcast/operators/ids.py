"""Set algebra on user and business ids, and the split of pairs into known and cold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.operators.skew import HeavyKeys, lookup_join
from starcast.session import materialize


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def possible_ids(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Ids that occur in the training ratings or in the pairs to score."""
    return train.select(key).union(test.select(key)).distinct()


def id_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).subtract(right.select(key))


def id_intersection(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def prune_entities(entities: DataFrame, ratings: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The users or businesses that take part in training or scoring."""
    return entities.join(possible_ids(ratings, pairs, key), key, "left_semi")


def unseen_ids(pairs: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Ids to score that have no entity row."""
    return distinct_ids(pairs, key).join(entities.select(key), key, "left_anti")


def mark_cold(
    pairs: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
) -> DataFrame:
    """``pairs`` plus ``is_cold``: the user or the business has no entity row."""
    known_users = distinct_ids(users, "user_id").withColumn("__has_user", F.lit(True))
    known_businesses = distinct_ids(businesses, "business_id").withColumn("__has_business", F.lit(True))
    marked = lookup_join(pairs, known_users, ["user_id"], "left", heavy_users)
    marked = lookup_join(marked, known_businesses, ["business_id"], "left", heavy_businesses)
    cold = F.col("__has_user").isNull() | F.col("__has_business").isNull()
    return marked.select(*pairs.columns, cold.alias("is_cold"))


def split_cold(pairs: DataFrame, users: DataFrame, businesses: DataFrame, **heavy) -> tuple[DataFrame, DataFrame]:
    """Pairs with both entity rows, and the rest; their join is written once."""
    marked = materialize(mark_cold(pairs, users, businesses, **heavy), "marked-pairs")
    return marked.where(~F.col("is_cold")).drop("is_cold"), marked.where("is_cold").drop("is_cold")
