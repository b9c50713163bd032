"""Friends who cannot have rated a business are filtered out, and no other."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from starcast.operators import friends


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    names = [f"u{i}" for i in range(300)]
    users = [(u, ", ".join(rng.sample(names, 60)) if i % 9 else "None") for i, u in enumerate(names)]
    rated = {(rng.choice(names), f"b{rng.randrange(12)}") for _ in range(500)} | {(u, "hot") for u in names[::2]}
    latest = [(u, b, float(rng.randrange(1, 6))) for u, b in sorted(rated)]
    pairs = [(rng.choice(names), rng.choice([f"b{rng.randrange(14)}", "hot"])) for _ in range(200)]
    return (
        spark.createDataFrame(pairs, "user_id string, business_id string"),
        spark.createDataFrame(users, "user_id string, friends string"),
        spark.createDataFrame(latest, "user_id string, business_id string, stars double").repartition(3),
    )


@pytest.mark.parametrize("most_words", [1024, 2])
def test_filters_change_no_row(tables, monkeypatch, most_words):
    monkeypatch.setattr(friends, "MOST_WORDS", most_words)
    pairs, users, latest = tables
    plain = rows_of(friends.mutual_friend_ratings(pairs, users, latest))
    assert plain and rows_of(friends.mutual_friend_ratings(pairs, users, latest, filters=friends.rater_filters(latest))) == plain


def test_filters_spare_rows(tables):
    pairs, users, latest = tables
    listed = friends.friend_edges(users.where("friends <> 'None'")).groupBy("user_id").agg(
        F.collect_set("friend_id").alias("friend_ids")
    )
    wanted = pairs.distinct().where("business_id <> 'hot'")
    before = friends.candidate_friends(wanted, listed).count()
    after = friends.candidate_friends(wanted, listed, filters=friends.rater_filters(latest)).count()
    assert after < before / 3


def test_filters_hold_all_raters_in_few_words(tables):
    _, _, latest = tables
    filters = friends.rater_filters(latest)
    held = latest.join(filters, "business_id").select(friends.may_have_rated(F.col("user_id"), F.col("filter")).alias("held"))
    assert {r.held for r in held.collect()} == {True}
    sizes = dict(rows_of(filters.select("business_id", F.size("filter"))))
    assert sizes["hot"] == 32 and all(size <= 8 for name, size in sizes.items() if name != "hot")
