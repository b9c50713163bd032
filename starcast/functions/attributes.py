"""Column functions over the ``attributes`` and ``hours`` maps of a business."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute keys and their labels in the source data; codes follow the alphabetical order of the labels.
PRICE_KEY = "RestaurantsPriceRange2"
NOISE_KEY = "NoiseLevel"
ALCOHOL_KEY = "Alcohol"
DRIVE_THRU_KEY = "DriveThru"
KIDS_KEY = "GoodForKids"
NOISE_CODES = {"average": 0, "loud": 1, "quiet": 2, "very_loud": 3}
DEFAULT_PRICE = "2"
DEFAULT_NOISE = "average"


def lookup(attrs: Column, key: str, default: str | None = None) -> Column:
    """Value of ``key``; ``default`` if the map lacks it; NULL if there is no map."""
    value = F.try_element_at(attrs, F.lit(key))
    if default is None:
        return value
    return F.when(attrs.isNotNull(), F.coalesce(value, F.lit(default)))


def _present(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def _coded(value: Column, codes: dict[str, int], what: str, on_unknown: str) -> Column:
    if on_unknown not in ("error", "null"):
        raise ValueError("on_unknown must be 'error' or 'null'")
    result = F.when(value.isNull(), F.lit(None).cast("int"))
    for label, code in codes.items():
        result = result.when(value == label, F.lit(code))
    if on_unknown == "null":
        return result
    return result.otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), value)).cast("int"))


def price_range(attrs: Column) -> Column:
    return _present(lookup(attrs, PRICE_KEY)).cast("int")


def price_range_default2(attrs: Column) -> Column:
    return lookup(attrs, PRICE_KEY, DEFAULT_PRICE).cast("int")


def noise_code(attrs: Column, on_unknown: str = "error") -> Column:
    return _coded(_present(lookup(attrs, NOISE_KEY)), NOISE_CODES, "noise level", on_unknown)


def noise_code_default_average(attrs: Column, on_unknown: str = "error") -> Column:
    return _coded(lookup(attrs, NOISE_KEY, DEFAULT_NOISE), NOISE_CODES, "noise level", on_unknown)


def alcohol_flag(attrs: Column) -> Column:
    value = _present(lookup(attrs, ALCOHOL_KEY))
    return F.when(value == "none", 0).when(value.isNotNull(), 1)


def true_false_flag(attrs: Column, key: str, on_unknown: str = "null") -> Column:
    return _coded(lookup(attrs, key), {"True": 1, "False": 0}, key, on_unknown)


def attribute_columns(attrs: Column, on_unknown: str = "null") -> dict[str, Column]:
    """The five attribute features by name; all NULL for a business without attributes."""
    return {
        "price": price_range(attrs),
        "noise": noise_code(attrs, on_unknown),
        "alcohol": alcohol_flag(attrs),
        "drive_thru": true_false_flag(attrs, DRIVE_THRU_KEY),
        "kids": true_false_flag(attrs, KIDS_KEY),
    }


def days_open(hours: Column) -> Column:
    """Number of days with opening hours; NULL for a missing or empty map."""
    return F.when(hours.isNotNull() & (F.size(hours) > 0), F.size(hours))
