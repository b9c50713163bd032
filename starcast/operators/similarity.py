"""Item-item similarity on common raters.

With s a rating in half stars, n the rows of a business and S their sum, the deviation of a rating from the business
mean is (n*s - S)/n. The factors 1/n cancel in the correlation, so numerator and both squared norms are whole
numbers that follow from six sums over the common raters: count, s_i, s_j, s_i^2, s_j^2 and s_i*s_j. The sums are small
BIGINTs whatever the order of rows, and the sign of the numerator is exact.

The common raters of two businesses are found in one of two ways, for each user the one with fewer rows. Either all pairs
of businesses that the user rated are formed, and those asked for are kept; or the shorter rater list of each pair asked
for is expanded, and each of its rows probes the other business by (business, user). So the many pairs without a common
rater cost nothing as long as histories are short, and neither a user nor a business that holds a third of all ratings is
ever expanded, except against one that is as large.

Long jobs are cut into slices of the pairs of businesses, one after the other, so the disk that shuffles hold has a bound. All
that a pair of businesses needs lies in the slice of its lower id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcast.operators.ratings import business_facts, rating_facts, user_facts
from starcast.operators.skew import (
    ROWS_PER_JOIN_BLOCK,
    HeavyKeys,
    blocked_join,
    heavy_from_counts,
    heavy_in_each,
    lookup_join,
)
from starcast.session import materialize, materialize_measured, materialize_parts, row_count

# The sums are combined as whole numbers of this type, once per pair of businesses.
EXACT = "decimal(38,0)"
# Rows that a slice pairs, all in all: the pairs of businesses asked for, and those that users rated.
ROWS_PER_SLICE = 600_000_000


def cf_candidates(
    pairs: DataFrame,
    history: DataFrame,
    heavy_pairs: HeavyKeys | None = None,
    heavy_history: HeavyKeys | None = None,
) -> DataFrame:
    """For each pair to score, every business its user rated: as ``other_id``, with the other columns of ``history``."""
    return blocked_join(
        pairs, history.withColumnRenamed("business_id", "other_id"), ["user_id"], heavy_pairs, heavy_history
    )


def order_by_raters(item: str, other: str, item_raters: str, other_raters: str) -> list[Column]:
    """The two businesses as ``small_id`` and ``large_id``; equal rater counts fall back to the id order."""
    first = F.struct(F.col(item_raters).alias("n"), F.col(item).alias("id"))
    second = F.struct(F.col(other_raters).alias("n"), F.col(other).alias("id"))
    return [F.least(first, second)["id"].alias("small_id"), F.greatest(first, second)["id"].alias("large_id")]


@dataclass(frozen=True)
class RatingTables:
    """The facts of the training ratings, their totals, the users and businesses with long rating lists, and how many pairs
    of own ratings all users have."""

    facts: DataFrame
    users: DataFrame
    businesses: DataFrame
    heavy_users: HeavyKeys
    heavy_businesses: HeavyKeys
    own_pairs: float


def rating_tables(ratings: DataFrame, order_cols: Sequence[str] = ()) -> RatingTables:
    facts = materialize(rating_facts(ratings, order_cols), "ratings")
    rated = F.col("rated").cast("double")
    users, of_users = materialize_measured(
        user_facts(facts), "rating-users", most=F.max("rated"), own_pairs=F.sum(rated * (rated + 1) / 2)
    )
    businesses, of_businesses = materialize_measured(
        business_facts(facts), "rating-businesses", most=F.max("raters")
    )
    return RatingTables(
        facts,
        users,
        businesses,
        heavy_from_counts(users, ["user_id"], "rated", ROWS_PER_JOIN_BLOCK, of_users["most"] or 0),
        heavy_from_counts(businesses, ["business_id"], "raters", ROWS_PER_JOIN_BLOCK, of_businesses["most"] or 0),
        of_users["own_pairs"] or 0.0,
    )


@dataclass(frozen=True)
class Slice:
    """One of several slices of the keys; together they hold all keys, and none is in two."""

    number: int = 0
    of: int = 1

    def holds(self, key: str | Column) -> Column:
        return F.lit(True) if self.of == 1 else F.pmod(F.xxhash64(key), F.lit(self.of)) == self.number


def slices_of(rows: float) -> int:
    """How many slices a job has that pairs so many rows."""
    return max(1, -int(-rows // ROWS_PER_SLICE))


def in_slices(
    spark: SparkSession, slices: int, build: Callable[[Slice], DataFrame], label: str, written: bool = False
) -> DataFrame:
    """The rows of ``build`` for every slice. Several slices are made and written one after the other; a single one is
    written if it shall be ``written``."""
    if slices == 1 and not written:
        return build(Slice())
    return materialize_parts(spark, [partial(build, Slice(number, slices)) for number in range(slices)], label)


@dataclass(frozen=True)
class ItemPairs:
    """A written table of distinct ``small_id, large_id``, and the businesses with very many partners on either side."""

    table: DataFrame
    heavy_small: HeavyKeys
    heavy_large: HeavyKeys


def item_pairs_table(oriented: DataFrame) -> ItemPairs:
    table, measured = materialize_measured(
        oriented.select("small_id", "large_id").distinct(), "item-pairs", total=row_count()
    )
    return ItemPairs(table, *heavy_in_each(table, ["small_id", "large_id"], ROWS_PER_JOIN_BLOCK, measured["total"]))


@dataclass(frozen=True)
class Routes:
    """How to find what each user has in common: ``users`` of ``user_id, walked``, and whether there are any of either kind.

    A user is walked if the pairs of the own ratings are no more than the pairs of businesses that the ratings would probe.
    Who is not listed rated no business that a pair begins with.
    """

    users: DataFrame
    any_walked: bool
    any_probing: bool


def routes(users: DataFrame, walks: Column, probes: Column) -> Routes:
    """``users``: one row per user with what the two numbers of rows are made of."""
    walked = walks <= probes
    table, measured = materialize_measured(
        users.where(probes > 0).select("user_id", walked.alias("walked")),
        "routes",
        walked=F.coalesce(F.bool_or("walked"), F.lit(False)),
        probing=F.coalesce(F.bool_or(~F.col("walked")), F.lit(False)),
    )
    return Routes(table, measured["walked"], measured["probing"])


def of_route(facts: DataFrame, found: Routes, walked: bool, heavy: HeavyKeys | None = None) -> DataFrame:
    """The rows of the users that go one way."""
    chosen = found.users.where(F.col("walked") == walked).select("user_id")
    return lookup_join(facts, chosen, ["user_id"], heavy=heavy)


def corated_routes(item_pairs: ItemPairs, tables: RatingTables, own: Slice = Slice()) -> Routes:
    partners = item_pairs.table.groupBy(F.col("small_id").alias("business_id")).agg(row_count().alias("partners"))
    probing = lookup_join(
        tables.facts.select("user_id", "business_id"), partners, ["business_id"], heavy=tables.heavy_businesses
    )
    probes = probing.groupBy("user_id").agg(F.sum("partners").alias("probes"))
    users = tables.users.select("user_id", F.col("rated").cast("double").alias("rated")).join(probes, "user_id")
    return routes(users, F.col("rated") * (F.col("rated") + 1) / (2 * own.of), F.col("probes"))


def _walked(item_pairs: ItemPairs, facts: DataFrame, tables: RatingTables, own: Slice) -> DataFrame:
    """``corated`` from all pairs of businesses that a user rated.

    A key (low, high) repeats at most as often as either business has raters.
    """
    low = facts.where(own.holds("business_id")).select(
        "user_id", F.col("business_id").alias("low_id"), F.col("half").alias("low_half")
    )
    high = facts.select("user_id", F.col("business_id").alias("high_id"), F.col("half").alias("high_half"))
    both = blocked_join(low, high, ["user_id"], tables.heavy_users, tables.heavy_users).where("low_id <= high_id")
    asked = item_pairs.table.select(
        F.least("small_id", "large_id").alias("low_id"), F.greatest("small_id", "large_id").alias("high_id"),
        (F.col("small_id") <= F.col("large_id")).alias("low_is_small"),
    )
    raters = tables.heavy_businesses
    found = lookup_join(both, asked, ["low_id", "high_id"], heavy=[raters.renamed("low_id"), raters.renamed("high_id")])

    def either(of_low: str, of_high: str) -> Column:
        return F.when(F.col("low_is_small"), F.col(of_low)).otherwise(F.col(of_high))

    return found.select(
        either("low_id", "high_id").alias("small_id"),
        either("high_id", "low_id").alias("large_id"),
        "user_id",
        either("low_half", "high_half").alias("small_half"),
        either("high_half", "low_half").alias("large_half"),
    )


def _probed(item_pairs: ItemPairs, facts: DataFrame, tables: RatingTables) -> DataFrame:
    """``corated`` from the shorter rater list of each pair.

    A probe key (large, user) repeats at most as often as the large business has partners, and at most as often as the
    user has ratings.
    """
    raters = facts.select(F.col("business_id").alias("small_id"), "user_id", F.col("half").alias("small_half"))
    probes = facts.select(F.col("business_id").alias("large_id"), "user_id", F.col("half").alias("large_half"))
    expanded = blocked_join(
        item_pairs.table,
        raters,
        ["small_id"],
        item_pairs.heavy_small,
        tables.heavy_businesses.renamed("small_id"),
    )
    found = lookup_join(expanded, probes, ["large_id", "user_id"], heavy=[item_pairs.heavy_large, tables.heavy_users])
    return found.select("small_id", "large_id", "user_id", "small_half", "large_half")


def corated(item_pairs: ItemPairs, tables: RatingTables, own: Slice = Slice()) -> DataFrame:
    """Users who rated both businesses: ``small_id, large_id, user_id, small_half, large_half``.

    ``own``: the slice that the lower ids of all ``item_pairs`` are in.
    """
    found = corated_routes(item_pairs, tables, own)
    facts = tables.facts.select("user_id", "business_id", "half")
    if not found.any_probing:
        return _walked(item_pairs, of_route(facts, found, True, tables.heavy_users), tables, own)
    probed = _probed(item_pairs, of_route(facts, found, False, tables.heavy_users), tables)
    if not found.any_walked:
        return probed
    walked = _walked(item_pairs, of_route(facts, found, True, tables.heavy_users), tables, own)
    return walked.unionByName(probed)


def corated_sums(common: DataFrame) -> DataFrame:
    """The six sums per pair of businesses with at least one common rater."""
    i, j = F.col("small_half"), F.col("large_half")
    return common.groupBy("small_id", "large_id").agg(
        F.count(F.lit(1)).alias("common"),
        F.sum(i).alias("s_i"),
        F.sum(j).alias("s_j"),
        F.sum(i * i).alias("s_ii"),
        F.sum(j * j).alias("s_jj"),
        F.sum(i * j).alias("s_ij"),
    )


def _centred() -> tuple[Column, Column, Column]:
    """Numerator and squared norms from the sums, exact up to their return as DOUBLE."""
    n_i, n_j, t_i, t_j, c, s_i, s_j, s_ii, s_jj, s_ij = (
        F.col(name).cast(EXACT)
        for name in ["n_i", "n_j", "t_i", "t_j", "common", "s_i", "s_j", "s_ii", "s_jj", "s_ij"]
    )
    dot = (n_i * n_j * s_ij - n_i * t_j * s_i) - (n_j * t_i * s_j - t_i * t_j * c)
    square_i = n_i * (n_i * s_ii - t_i * s_i) - t_i * (n_i * s_i - t_i * c)
    square_j = n_j * (n_j * s_jj - t_j * s_j) - t_j * (n_j * s_j - t_j * c)
    return dot.cast("double"), square_i.cast("double"), square_j.cast("double")


def similarity_column() -> Column:
    """Correlation from the six sums and the totals ``n_i, t_i, n_j, t_j``; 1 if either side does not vary."""
    dot, square_i, square_j = _centred()
    return F.when((square_i == 0) | (square_j == 0), F.lit(1.0)).otherwise(dot / (F.sqrt(square_i) * F.sqrt(square_j)))


def overlapping_similarity(item_pairs: ItemPairs, tables: RatingTables, own: Slice = Slice()) -> DataFrame:
    """``small_id, large_id, common, similarity`` for the pairs with a common rater."""
    sums = corated_sums(corated(item_pairs, tables, own))
    totals = tables.businesses.select("business_id", "rows", "row_halves")
    sums = lookup_join(sums, totals.toDF("small_id", "n_i", "t_i"), ["small_id"], heavy=item_pairs.heavy_small)
    sums = lookup_join(sums, totals.toDF("large_id", "n_j", "t_j"), ["large_id"], heavy=item_pairs.heavy_large)
    return sums.select("small_id", "large_id", "common", similarity_column().alias("similarity"))


def oriented_pairs(
    given: DataFrame, tables: RatingTables, heavy: Sequence[HeavyKeys | None] = (None, None)
) -> DataFrame:
    """``given`` pairs ``item_id, other_id`` of rated businesses, with ``small_id`` and ``large_id``."""
    raters = tables.businesses.select("business_id", "raters")
    for side, of_side in zip(("item_id", "other_id"), heavy):
        given = lookup_join(given, raters.toDF(side, f"{side}_raters"), [side], heavy=of_side)
    return given.select(
        "item_id", "other_id", *order_by_raters("item_id", "other_id", "item_id_raters", "other_id_raters")
    )


def item_similarity(item_pairs: DataFrame, tables: RatingTables, written: bool = False) -> DataFrame:
    """Similarity of every given pair ``item_id, other_id`` of rated businesses.

    Two businesses without a common rater have similarity 1, as have two whose common ratings do not vary. ``written``: as a
    written table, for who reads it several times.
    """
    given, measured = materialize_measured(
        item_pairs.select("item_id", "other_id").distinct(), "given-item-pairs", total=row_count()
    )
    heavy = heavy_in_each(given, ["item_id", "other_id"], ROWS_PER_JOIN_BLOCK, measured["total"])

    def build(own: Slice) -> DataFrame:
        part = given.where(own.holds(F.least("item_id", "other_id")))
        # Read by the search for common raters, and by the join with what it found.
        oriented = materialize(oriented_pairs(part, tables, heavy), "oriented-item-pairs")
        similar = overlapping_similarity(item_pairs_table(oriented), tables, own)
        return oriented.join(similar, ["small_id", "large_id"], "left").select(
            "item_id",
            "other_id",
            F.coalesce("common", F.lit(0)).cast("long").alias("common"),
            F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
        )

    slices = slices_of(measured["total"] + tables.own_pairs)
    return in_slices(given.sparkSession, slices, build, "similarities", written)


def positive_similarities(similarities: DataFrame) -> DataFrame:
    return similarities.where(F.col("similarity") > 0)


def weighted_prediction(neighbours: DataFrame, keys: tuple[str, ...] = ("user_id", "business_id")) -> DataFrame:
    """Mean of ``stars`` weighted by the positive ``similarity``; NULL for a pair without a positive one."""
    weight = F.greatest(F.col("similarity"), F.lit(0.0))
    return neighbours.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("stars") * weight), F.sum(weight)).alias("prediction")
    )
