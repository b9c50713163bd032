"""Readers and writers: ratings, pairs and predictions as CSV, users and businesses as JSON lines.

All readers are strict: a malformed line, a number that is none, a header with other names or another order, and a
missing id or rating are errors, not silently missing values. They surface when the rows are computed. The ``*_or_rejects``
readers put such lines into a table of their own instead, so that one bad line does not end a job.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcast.schemas import BUSINESS, PREDICTION, RATING, USER
from starcast.session import materialize_measured
from starcast.sources import folders

#: The text of a line that could not be read.
LINE = "rejected_line"


def _required(df: DataFrame, *names: str) -> DataFrame:
    def present(name: str) -> Column:
        missing = F.raise_error(F.lit(f"a row without {name}")).cast(df.schema[name].dataType)
        return F.when(F.col(name).isNull(), missing).otherwise(F.col(name)).alias(name)

    return df.select(*[present(name) if name in names else F.col(name) for name in df.columns])


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)
    return _required(rows, *schema.names)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, business_id, stars`` from CSV with a header line."""
    return _read_csv(spark, path, RATING)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pairs to score. A third, usually empty, field is ignored."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    return _required(rows.select("user_id", "business_id"), "user_id", "business_id")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Known ratings of scored pairs; same layout as the training ratings."""
    return _read_csv(spark, path, RATING)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, business_id, prediction`` as :func:`write_predictions` leaves them. A prediction may be missing."""
    rows = spark.read.csv(path, schema=PREDICTION, header=True, mode="FAILFAST", enforceSchema=False)
    return _required(rows, "user_id", "business_id")


def read_users(spark: SparkSession, path: str, schema: T.StructType = USER) -> DataFrame:
    return _required(spark.read.json(path, schema=schema, mode="FAILFAST"), "user_id")


def read_businesses(spark: SparkSession, path: str, schema: T.StructType = BUSINESS) -> DataFrame:
    return _required(spark.read.json(path, schema=schema, mode="FAILFAST"), "business_id")


@dataclass(frozen=True)
class Read:
    """What a tolerant reader found: the good rows, the others, and how many there are of each.

    ``rejected`` holds the fields as far as they could be read, the whole line if it could not, and a ``reason``.
    """

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def _quarantined(rows: DataFrame, required: tuple[str, ...], label: str) -> Read:
    reason = F.when(F.col(LINE).isNotNull(), F.lit("malformed"))
    for name in required:
        reason = reason.when(F.col(name).isNull(), F.lit(f"no {name}"))
    # Written once: good and rejected rows come from the same reading, and the counts from its pass.
    table, counts = materialize_measured(
        rows.withColumn("reason", reason),
        label,
        good=F.count_if(F.col("reason").isNull()),
        rejected=F.count_if(F.col("reason").isNotNull()),
    )
    return Read(
        table.where("reason IS NULL").drop("reason", LINE), table.where("reason IS NOT NULL"), counts["good"], counts["rejected"]
    )


def read_ratings_or_rejects(spark: SparkSession, path: str) -> Read:
    """As :func:`read_ratings`. The header line must still be the right one."""
    schema = T.StructType([*RATING.fields, T.StructField(LINE, T.StringType())])
    rows = spark.read.csv(
        path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=False, columnNameOfCorruptRecord=LINE
    )
    return _quarantined(rows, tuple(RATING.names), "ratings-read")


def _json_or_rejects(spark: SparkSession, path: str, schema: T.StructType, key: str) -> Read:
    wide = T.StructType([*schema.fields, T.StructField(LINE, T.StringType())])
    rows = spark.read.json(path, schema=wide, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE)
    return _quarantined(rows, (key,), f"{key}-read")


def read_users_or_rejects(spark: SparkSession, path: str, schema: T.StructType = USER) -> Read:
    """As :func:`read_users`."""
    return _json_or_rejects(spark, path, schema, "user_id")


def read_businesses_or_rejects(spark: SparkSession, path: str, schema: T.StructType = BUSINESS) -> Read:
    """As :func:`read_businesses`."""
    return _json_or_rejects(spark, path, schema, "business_id")


def write_predictions(df: DataFrame, path: str) -> None:
    """A folder of CSV part files, each with the header line.

    The files are written next to ``path``, which is replaced only once all of them are there. If that fails, the result
    of before stays where it is. Renaming a folder is one step in a file system; a store that copies instead needs a
    committer of its own.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    token = uuid.uuid4().hex
    aside, before = f"{path}._new_{token}", f"{path}._old_{token}"
    try:
        df.select("user_id", "business_id", "prediction").write.option("header", True).csv(aside)
        folders.replace(spark, aside, path, before)
    finally:
        folders.remove(spark, aside)
