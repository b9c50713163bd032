"""Declared schemas of the source files."""

from pyspark.sql import types as T

# The column names of the source files.
COMPLIMENTS = [
    "compliment_hot", "compliment_more", "compliment_profile", "compliment_cute", "compliment_list", "compliment_note",
    "compliment_plain", "compliment_cool", "compliment_funny", "compliment_writer", "compliment_photos",
]

RATING = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("stars", T.DoubleType()),
])

PREDICTION = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("business_id", T.StringType()),
    T.StructField("prediction", T.DoubleType()),
])

USER = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("yelping_since", T.StringType()),
        T.StructField("friends", T.StringType()),
        T.StructField("useful", T.LongType()),
        T.StructField("funny", T.LongType()),
        T.StructField("cool", T.LongType()),
        T.StructField("fans", T.LongType()),
        T.StructField("elite", T.StringType()),
        T.StructField("average_stars", T.DoubleType()),
    ]
    + [T.StructField(name, T.LongType()) for name in COMPLIMENTS]
)

BUSINESS = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("neighborhood", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("postal_code", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("is_open", T.LongType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("categories", T.StringType()),
    T.StructField("hours", T.MapType(T.StringType(), T.StringType())),
])
