"""The fold of each training row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD = "__fold"


def fold_column(keys: Sequence[str], folds: int) -> Column:
    """A fold number from a hash of the keys: the same in every run, and one fold for all copies of a row."""
    return F.pmod(F.xxhash64(*keys), F.lit(folds)).cast("int")
