"""Features of users, businesses and pairs as named DOUBLE columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcast.functions.attributes import (
    attribute_columns,
    days_open,
    noise_code_default_average,
    price_range_default2,
)
from starcast.functions.text import elite_count, friend_count, postal_code_point, split_categories, start_year
from starcast.operators.ratings import column_means
from starcast.operators.skew import HeavyKeys, lookup_join
from starcast.session import materialize

TOP_CATEGORIES = 30
# Columns that are no features, and the rows that stand in for a missing user or business.
USER_TEXT = ["name", "friends"]
BUSINESS_TEXT = [
    "name", "neighborhood", "address", "city", "state", "latitude", "longitude", "categories", "attributes",
]
LINEAR_USER_DEFAULTS = {"review_count": 0, "average_stars": 2.5, "useful": 0}
LINEAR_BUSINESS_DEFAULTS = {"stars": 2.5, "review_count": 0, "price": None, "state": None, "noise": None}


def user_feature_columns(users: DataFrame) -> DataFrame:
    return users.drop(*USER_TEXT)


def business_feature_columns(businesses: DataFrame) -> DataFrame:
    return businesses.drop(*BUSINESS_TEXT)


# Categories


def category_counts(businesses: DataFrame) -> DataFrame:
    """``category, count``: how often each label is listed."""
    listed = businesses.select(F.explode(split_categories(F.col("categories"))).alias("category"))
    return listed.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


def top_categories(businesses: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    """The ``k`` most frequent labels; equal counts by name."""
    return category_counts(businesses).orderBy(F.desc("count"), "category").limit(k)


def category_labels(businesses: DataFrame, k: int = TOP_CATEGORIES) -> list[str]:
    """The top labels in alphabetical order, which is the order of their flag columns."""
    return sorted(row["category"] for row in top_categories(businesses, k).collect())


def flag_columns(labels: Sequence[str]) -> list[str]:
    return [f"category_{i:02d}" for i in range(len(labels))]


def category_flags(categories: Column, labels: Sequence[str], missing: str = "null") -> dict[str, Column]:
    """One 0/1 column per label. A business without categories gets NULLs, or zeros with ``missing='zero'``."""
    if missing not in ("null", "zero"):
        raise ValueError("missing must be 'null' or 'zero'")
    listed = F.split(categories, ", ")
    flags = {}
    for name, label in zip(flag_columns(labels), labels):
        flag = F.array_contains(listed, F.lit(label)).cast("int")
        flags[name] = F.coalesce(flag, F.lit(0)) if missing == "zero" else flag
    return flags


# States


def state_codes(businesses: DataFrame) -> DataFrame:
    """``state, state_code``: position of each state in alphabetical order, from 0.

    States are sorted in ranges; a code is the position in its range plus the lengths of the ranges before. The
    ranges are written first, so that positions and lengths see the same ones.
    """
    states = businesses.select("state").where(F.col("state").isNotNull()).distinct()
    ranges = states.repartitionByRange("state").withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy("state"))
    placed = materialize(ranges.withColumn("place", place), "states")
    # One row per range, of which there are no more than shuffle partitions.
    lengths = placed.groupBy("part").agg(F.count(F.lit(1)).alias("length"))
    before = F.sum("length").over(Window.orderBy("part")) - F.col("length")
    offsets = F.broadcast(lengths.select("part", before.alias("before")))
    return placed.join(offsets, "part").select("state", (F.col("before") + F.col("place") - 1).alias("state_code"))


# Feature tables, one row per user or business


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def user_features(users: DataFrame, strict_years: bool = True) -> DataFrame:
    """``user_id`` and every numeric field, the start year and the counts of elite years and friends, as ``u_*``."""
    derived = {
        "yelping_since": start_year(F.col("yelping_since"), strict_years),
        "elite": elite_count(F.col("elite")),
        "friends_cnt": friend_count(F.col("friends")),
    }
    kept = [c for c in user_feature_columns(users).columns if c in derived or (c != "user_id" and _numeric(users, c))]
    return users.select(
        "user_id",
        *[derived.get(c, F.col(c)).cast("double").alias(f"u_{c}") for c in [*kept, "friends_cnt"]],
    )


def business_features(
    businesses: DataFrame, labels: Sequence[str], on_unknown: str = "null", carry: Sequence[str] = ()
) -> DataFrame:
    """``business_id`` and numeric fields, postal code point, days open, category flags and attributes, as ``b_*``, and
    the fields of ``carry`` as they are."""
    derived = {
        "postal_code": postal_code_point(F.col("postal_code")),
        "hours": days_open(F.col("hours")),
    }
    kept = [
        c
        for c in business_feature_columns(businesses).columns
        if c in derived or (c != "business_id" and _numeric(businesses, c))
    ]
    columns = {c: derived.get(c, F.col(c)) for c in kept}
    columns |= category_flags(F.col("categories"), labels)
    columns |= attribute_columns(F.col("attributes"), on_unknown)
    return businesses.select(
        "business_id", *carry, *[column.cast("double").alias(f"b_{name}") for name, column in columns.items()]
    )


def linear_user_view(users: DataFrame) -> DataFrame:
    return users.select("user_id", *LINEAR_USER_DEFAULTS)


def linear_business_view(businesses: DataFrame, labels: Sequence[str], on_unknown: str = "error") -> DataFrame:
    """``business_id, stars, review_count, price, state, noise`` and the flags, with a default per missing attribute."""
    flags = category_flags(F.col("categories"), labels, missing="zero")
    narrow = businesses.select(
        "business_id",
        "stars",
        "review_count",
        price_range_default2(F.col("attributes")).alias("price"),
        "state",
        noise_code_default_average(F.col("attributes"), on_unknown).alias("noise"),
        *[column.alias(name) for name, column in flags.items()],
    )
    coded = lookup_join(narrow, state_codes(businesses), ["state"], "left")
    return coded.withColumn("state", F.col("state_code")).select(*narrow.columns)


# Attaching features to pairs


def _attach(
    pairs: DataFrame, features: DataFrame, key: str, strict: bool, heavy: HeavyKeys | None
) -> DataFrame:
    if not strict:
        return lookup_join(pairs, features, [key], "inner", heavy)
    marked = lookup_join(pairs, features.withColumn("__found", F.lit(True)), [key], "left", heavy)
    checked = F.when(F.col("__found"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit(f"no entity row for {key} "), F.col(key).cast("string"))).cast(
            pairs.schema[key].dataType
        )
    )
    return marked.withColumn(key, checked).drop("__found")


def attach_user_features(
    pairs: DataFrame, features: DataFrame, strict: bool = False, heavy: HeavyKeys | None = None
) -> DataFrame:
    """``pairs`` with the features of their user; a pair without is left out, or raises when ``strict``."""
    return _attach(pairs, features, "user_id", strict, heavy)


def attach_business_features(
    pairs: DataFrame, features: DataFrame, strict: bool = False, heavy: HeavyKeys | None = None
) -> DataFrame:
    """As :func:`attach_user_features`, for the business."""
    return _attach(pairs, features, "business_id", strict, heavy)


def default_rows(labels: Sequence[str]) -> tuple[dict, dict]:
    """What the linear model assumes of a user or business without a row."""
    return dict(LINEAR_USER_DEFAULTS), LINEAR_BUSINESS_DEFAULTS | dict.fromkeys(flag_columns(labels), 0)


def _attach_default(
    pairs: DataFrame, view: DataFrame, key: str, prefix: str, defaults: Mapping, heavy: HeavyKeys | None
) -> DataFrame:
    marked = view.select(
        key, F.lit(True).alias("__found"), *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in defaults]
    )
    joined = lookup_join(pairs, marked, [key], "left", heavy)
    # The default stands in for a missing row only: a missing value of an existing row stays missing.
    filled = {
        f"{prefix}{c}": F.when(F.col("__found").isNull(), F.lit(value).cast("double")).otherwise(F.col(f"{prefix}{c}"))
        for c, value in defaults.items()
    }
    return joined.withColumns(filled).drop("__found")


def attach_with_defaults(
    pairs: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    labels: Sequence[str],
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
) -> DataFrame:
    """``pairs`` with the linear views of both sides as ``u_*`` and ``b_*``; every pair is kept."""
    user_defaults, business_defaults = default_rows(labels)
    with_user = _attach_default(pairs, users, "user_id", "u_", user_defaults, heavy_users)
    return _attach_default(with_user, businesses, "business_id", "b_", business_defaults, heavy_businesses)


def assemble_pair_features(
    pairs: DataFrame,
    user_table: DataFrame,
    business_table: DataFrame,
    friend_means: DataFrame,
    strict: bool = False,
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
    heavy_pairs: HeavyKeys | None = None,
) -> DataFrame:
    """User features, business features and the mean rating given by friends, for each pair with both entity rows."""
    # The narrow side first: the wide feature rows are shuffled as late as possible.
    rows = lookup_join(pairs, friend_means, ["user_id", "business_id"], "left", heavy_pairs)
    rows = attach_user_features(rows, user_table, strict, heavy_users)
    return attach_business_features(rows, business_table, strict, heavy_businesses)


def feature_names(rows: DataFrame) -> list[str]:
    """The feature columns in a fixed order: user, business, friends."""
    return [
        *[c for c in rows.columns if c.startswith("u_")],
        *[c for c in rows.columns if c.startswith("b_")],
        *[c for c in rows.columns if c == "friend_mean"],
    ]


# Missing values

# Which column's mean fills which column.
FILL_SOURCES = {
    "u_yelping_since": "u_yelping_since",
    "u_average_stars": "u_average_stars",
    "b_stars": "b_stars",
    "friend_mean": "u_average_stars",
}


def fill_values(stats_from: DataFrame, cols: Sequence[str], sources: Mapping[str, str] = FILL_SOURCES) -> dict:
    """The value that stands in for a missing one: the mean of a source column, else 0."""
    needed = sorted({sources[c] for c in cols if c in sources})
    means = column_means(stats_from, needed).first().asDict() if needed else {}
    return {c: (means[sources[c]] or 0.0) if c in sources else 0.0 for c in cols}


def fill_mean(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    """``df`` with NULL and NaN replaced, as DOUBLE columns."""
    return df.withColumns({c: F.expr(f"cast(`{c}` as double)") for c in values}).fillna(dict(values))


def missing_flags(df: DataFrame, cols: Sequence[str], fill: float = 0.0) -> DataFrame:
    """``df`` with a 0/1 column ``<name>_missing`` per column of ``cols``, and ``fill`` in place of missing values."""
    flagged = df.withColumns({
        f"{c}_missing": F.expr(f"cast(`{c}` is null or isnan(`{c}`) as double)") for c in cols
    })
    return fill_mean(flagged, dict.fromkeys(cols, fill))
