"""Column functions over the text fields of users and businesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = ", "
NO_ENTRIES = "None"


def _parts(col: Column) -> Column:
    return F.split(col, SEPARATOR)


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def split_categories(col: Column) -> Column:
    """Category labels in file order; a missing list has none, an empty text has one empty label."""
    return F.coalesce(_parts(col), _no_strings())


def keep_top(labels: Column, top: Sequence[str]) -> Column:
    """The distinct labels that are among ``top``."""
    return F.array_intersect(labels, F.array(*[F.lit(label) for label in top]).cast("array<string>"))


def friend_list(col: Column) -> Column:
    """Distinct friend ids."""
    return F.array_distinct(F.when(col == NO_ENTRIES, _no_strings()).otherwise(_parts(col)))


def entry_count(col: Column) -> Column:
    """Number of listed entries, repeats included."""
    return F.when(col == NO_ENTRIES, 0).otherwise(F.size(_parts(col)))


def friend_count(col: Column) -> Column:
    return entry_count(col)


def elite_count(col: Column) -> Column:
    return entry_count(col)


def start_year(col: Column, strict: bool = True) -> Column:
    """The year a date text starts with. Text that is no year raises, or gives NULL when not ``strict``."""
    year = F.substring(col, 1, 4)
    return year.cast("int") if strict else year.try_cast("int")


def postal_code_point(col: Column) -> Column:
    """Code point of the first character; NULL for a missing or empty code."""
    return F.when(F.length(col) > 0, F.ascii(F.substring(col, 1, 1)))
