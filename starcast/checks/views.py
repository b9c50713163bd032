"""The test tables seen as ratings: customers are users, parts are businesses, order lines are ratings.

The remainders below are the split itself. One order in five, and the lines of some users and businesses, are held out
of training, and all that is held out is scored: an order line either trains or is scored. Some users and businesses
have no training rows, and to some queries some have no entity row, so that every cold case occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A user can rate a business more than once. The later order line counts; order line numbers repeat, hence the tail.
RATING_ORDER = ["k", "ln", "sk", "q"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(col: str, n: int) -> Column:
    return F.col(col) % n == 0


def raw_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("user_id"))
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_partkey").alias("business_id"),
        (F.col("l_quantity").cast("bigint") % 5 + 1).alias("stars"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("q"),
    )
    # The join shuffles large tables by order in any case. Asking for it spreads the rows of a small file, which is read
    # by one task, over all of them.
    return lines.repartition("k").join(orders, "k")


def _held_out() -> Column:
    return _every("k", 5) | _every("user_id", 29) | _every("business_id", 43)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_ratings(spark, sf_dir).where(~_held_out())


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_ratings(spark, sf_dir).where(_held_out())


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir).select("user_id", "business_id").distinct()


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out(spark, sf_dir).groupBy("user_id", "business_id").agg(F.max("stars").alias("stars"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users with an entity row, for queries with a cold case."""
    return all_users(spark, sf_dir).where(~_every("user_id", 37))


def all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = (
        _table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.year("o_orderdate")).alias("y0"))
    )
    key = F.col("c_custkey")
    n = F.coalesce("n", F.lit(0))
    friends = F.concat_ws(", ", *[(key + step).cast("string") for step in (1, 25, 2)])
    return (
        _table(spark, sf_dir, "customer")
        .join(ordered, "c_custkey", "left")
        .select(
            key.alias("user_id"),
            F.col("c_name").alias("name"),
            n.alias("review_count"),
            F.concat(F.coalesce("y0", F.lit(1992)).cast("string"), F.lit("-01-01")).alias("yelping_since"),
            F.when(key % 7 == 0, "None").otherwise(friends).alias("friends"),
            F.when(n < 8, "None").when(n < 12, "1996").otherwise("1996, 1997").alias("elite"),
            (n * 3).alias("useful"),
            (1 + key % 9 * 0.5).cast("double").alias("average_stars"),
        )
    )


def _choice(col: Column, *labels: str) -> Column:
    chosen = F.when(col == 0, labels[0])
    for code, label in enumerate(labels[1:], 1):
        chosen = chosen.when(col == code, label)
    return chosen


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The businesses with an entity row, for queries with a cold case."""
    return all_businesses(spark, sf_dir).where(~_every("business_id", 41))


def all_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses with ``attributes`` and ``hours`` as maps, as they come from the source files."""
    key, size = F.col("p_partkey"), F.col("p_size")
    attributes = {
        "RestaurantsPriceRange2": F.when(size % 6 != 0, (1 + size % 4).cast("string")),
        "NoiseLevel": _choice(size % 5, "quiet", "average", "loud", "very_loud"),
        "Alcohol": _choice(key % 3, "none", "full_bar"),
        "DriveThru": _choice(key % 4, "True", "False"),
        "GoodForKids": _choice(size % 3, "True", "False"),
    }
    entries = F.array(*[F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in attributes.items()])
    present = F.map_from_entries(F.filter(entries, lambda entry: entry["value"].isNotNull()))
    days = F.when(size % 8 > 0, F.sequence(F.lit(1), size % 8)).otherwise(F.array().cast("array<int>"))
    hours = F.map_from_entries(
        F.transform(days, lambda day: F.struct(day.cast("string").alias("key"), F.lit("9:0-17:0").alias("value")))
    )
    labels = F.concat_ws(", ", F.replace("p_name", F.lit(" "), F.lit(", ")), "p_type", "p_brand")
    return (
        _table(spark, sf_dir, "part")
        .select(
            key.alias("business_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("state"),
            F.when(key % 23 == 0, None)
            .when(key % 19 == 0, "")
            .otherwise((10000 + key * 7).cast("string"))
            .alias("postal_code"),
            (1 + key % 9 * 0.5).cast("double").alias("stars"),
            size.alias("review_count"),
            (key % 2).alias("is_open"),
            F.when(key % 17 != 0, labels).alias("categories"),
            F.when(key % 13 != 0, present).alias("attributes"),
            F.when(key % 11 != 0, hours).alias("hours"),
        )
    )
