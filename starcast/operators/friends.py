"""Ratings that a user's friends gave the business to be scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcast.functions.text import friend_list
from starcast.operators.skew import HeavyKeys, heavy_keys, lookup_join


def _friends(users: DataFrame) -> Column:
    """Distinct friends of a user, as ids of the same type as ``user_id``."""
    return friend_list(F.col("friends")).cast(T.ArrayType(users.schema["user_id"].dataType))


def friend_edges(users: DataFrame) -> DataFrame:
    """``user_id, friend_id``, each once."""
    return users.select("user_id", F.explode(_friends(users)).alias("friend_id"))


def popular_friends(users: DataFrame) -> HeavyKeys:
    """Users listed as a friend by very many others."""
    return heavy_keys(friend_edges(users), ["friend_id"])


# A filter has eight bits for each rater up to 65,536 bits; a larger business shares them, and its filter lets more through.
BITS_PER_RATER, MOST_WORDS = 8, 1024


def rater_filters(latest: DataFrame) -> DataFrame:
    """``business_id`` and ``filter``: bits of the hashes of its raters, as a list of BIGINTs whose length is a power of 2.

    Bits are combined before the shuffle and per business and list entry, so a business with very many raters is never
    gathered: it reaches the last step as at most ``MOST_WORDS`` entries.
    """
    hashed = F.xxhash64("user_id")
    entry, bit = F.pmod(hashed, F.lit(MOST_WORDS)).cast("int"), F.pmod(F.shiftright(hashed, 10), F.lit(64)).cast("int")
    bits = latest.select("business_id", entry.alias("entry"), F.expr("1L").alias("one"), bit.alias("bit"))
    entries = bits.groupBy("business_id", "entry").agg(
        F.expr("bit_or(shiftleft(one, bit))").alias("bits"), F.count(F.lit(1)).alias("raters")
    )
    listed = entries.groupBy("business_id").agg(
        F.sum("raters").alias("raters"), F.collect_list(F.struct("entry", "bits")).alias("entries")
    )
    words = F.expr(f"cast(least({MOST_WORDS}, pow(2, greatest(0, ceil(log2(raters * {BITS_PER_RATER} / 64))))) as int)")
    folded = F.expr(
        "transform(sequence(0, words - 1), w -> aggregate(filter(entries, e -> e.entry % words = w), 0L, (a, e) -> a | e.bits))"
    )
    return listed.withColumn("words", words).select("business_id", folded.alias("filter"))


def may_have_rated(friend: Column, filter_: Column) -> Column:
    """False only if the friend is certainly not among the raters behind the filter."""
    hashed = F.xxhash64(friend)
    entry = (F.pmod(hashed, F.lit(MOST_WORDS)) % F.size(filter_)).cast("int")
    bit = F.pmod(F.shiftright(hashed, 10), F.lit(64)).cast("int")
    return F.call_function("shiftrightunsigned", F.get(filter_, entry), bit).bitwiseAND(F.lit(1)) == 1


def candidate_friends(
    pairs: DataFrame,
    listed: DataFrame,
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
    filters: DataFrame | None = None,
) -> DataFrame:
    """``user_id, business_id, friend_id`` for the friends in ``friend_ids`` of each pair's user; with ``filters`` only for
    those who may have rated the business, taken out of the list before it becomes rows."""
    befriended = lookup_join(pairs, listed, ["user_id"], heavy=heavy_users)
    friends = F.col("friend_ids")
    if filters is not None:
        befriended = lookup_join(befriended, filters, ["business_id"], heavy=heavy_businesses)
        friends = F.filter(friends, lambda friend: may_have_rated(friend, F.col("filter")))
    return befriended.select("user_id", "business_id", F.explode(friends).alias("friend_id"))


def mutual_friend_ratings(
    pairs: DataFrame,
    users: DataFrame,
    latest: DataFrame,
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
    popular: HeavyKeys | None = None,
    filters: DataFrame | None = None,
) -> DataFrame:
    """For each distinct pair, the last rating of its business by each friend of its user.

    Friends who rated nothing are removed first, once per user. What is left stays one list per user up to the join, so
    that a pair is shuffled once and not once per friend. The key (friend, business) repeats at most as often as the
    business has pairs, and as the friend is listed. ``filters``, of :func:`rater_filters`, spare most friends who did not
    rate the business that way; they pay where users have many friends, and change no row.
    """
    distinct = pairs.select("user_id", "business_id").distinct()
    raters = latest.select(F.col("user_id").alias("friend_id")).distinct()
    edges = friend_edges(users.where(F.col("friends") != "None")).join(raters, "friend_id", "left_semi")
    listed = edges.groupBy("user_id").agg(F.collect_set("friend_id").alias("friend_ids"))
    befriended = candidate_friends(distinct, listed, heavy_users, heavy_businesses, filters)
    return lookup_join(
        befriended,
        latest.select(F.col("user_id").alias("friend_id"), "business_id", "stars"),
        ["friend_id", "business_id"],
        heavy=[popular, heavy_businesses],
    ).select("user_id", "business_id", "friend_id", "stars")


def mutual_friend_mean(
    pairs: DataFrame,
    users: DataFrame,
    latest: DataFrame,
    heavy_users: HeavyKeys | None = None,
    heavy_businesses: HeavyKeys | None = None,
    popular: HeavyKeys | None = None,
) -> DataFrame:
    """``user_id, business_id, friend_mean`` for the distinct pairs that have a friend's rating."""
    rated = mutual_friend_ratings(pairs, users, latest, heavy_users, heavy_businesses, popular)
    return rated.groupBy("user_id", "business_id").agg(F.avg("stars").alias("friend_mean"))
