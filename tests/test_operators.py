import data
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from starcast.operators import coldstart, errors, features, friends, ids, ratings as r
from starcast.operators.skew import heavy_keys
from starcast.plans.evaluation import evaluate


def test_id_algebra(spark):
    rated, pairs, users = data.ratings(spark), data.pairs(spark), data.users(spark)
    assert rows_of(ids.possible_ids(rated, pairs, "business_id")) == [("b1",), ("b2",), ("b3",), ("new",)]
    assert rows_of(ids.prune_entities(users, rated, pairs, "user_id"), "user_id") == [("u1",), ("u2",), ("u3",)]
    assert rows_of(ids.unseen_ids(pairs, users, "user_id")) == [("ghost",)]
    assert rows_of(ids.id_difference(pairs, users, "user_id")) == [("ghost",)]
    assert rows_of(ids.id_intersection(pairs, users, "user_id")) == [("u1",), ("u2",)]


def test_pruning_is_a_semi_join(spark):
    pruned = ids.prune_entities(data.users(spark), data.ratings(spark), data.pairs(spark), "user_id")
    assert "LeftSemi" in pruned._jdf.queryExecution().executedPlan().toString()


def test_split_cold(spark):
    known, cold = ids.split_cold(data.pairs(spark), data.users(spark), data.businesses(spark))
    assert rows_of(known) == [("u1", "b1"), ("u1", "b3"), ("u2", "b2")]
    assert rows_of(cold) == [("ghost", "b1"), ("ghost", "new"), ("u1", "new")]


def test_rating_aggregates(spark):
    rated = data.ratings(spark)
    latest = r.latest_rating(rated, ["n"])
    assert latest.where("user_id = 'u2' and business_id = 'b1'").first()["stars"] == 5.0
    assert latest.count() == 7
    means = dict(rows_of(r.business_mean(rated)))
    assert means == {"b1": 3.5, "b2": 2.0, "b3": 3.5}
    assert dict(rows_of(r.cold_user_mean(latest)))["b1"] == pytest.approx(11 / 3)
    assert dict(rows_of(r.cold_business_mean(latest)))["u2"] == 3.5
    assert r.global_mean(rated).first()[0] == pytest.approx(25 / 8)
    assert r.raters_by_business(rated).count() == 7
    gaps = spark.createDataFrame([(1.0, None), (float("nan"), None), (2.0, None)], "a double, b double")
    assert r.column_means(gaps, ["a", "b"]).first().asDict() == {"a": 1.5, "b": None}


def test_friend_ratings(spark):
    latest = r.latest_rating(data.ratings(spark), ["n"])
    args = (data.pairs(spark), data.users(spark), latest)
    expected = [("u1", "b1", "u2", 5.0), ("u1", "b1", "u3", 2.0), ("u1", "b3", "u2", 2.0), ("u1", "b3", "u3", 5.0)]
    assert rows_of(friends.mutual_friend_ratings(*args)) == expected
    assert rows_of(friends.mutual_friend_mean(*args)) == [("u1", "b1", 3.5), ("u1", "b3", 3.5)]
    heavy = {
        "heavy_users": heavy_keys(args[0], ["user_id"], 1),
        "heavy_businesses": heavy_keys(args[0], ["business_id"], 1),
        "popular": heavy_keys(friends.friend_edges(args[1]), ["friend_id"], 1),
    }
    assert rows_of(friends.mutual_friend_ratings(*args, **heavy)) == expected


def test_categories(spark):
    used = data.businesses(spark).where("business_id <> 'unused'")
    assert rows_of(features.category_counts(used)) == [("Bars", 1), ("Food", 2), ("Golf", 1)]
    assert [row["category"] for row in features.top_categories(used, 2).collect()] == ["Food", "Bars"]
    labels = features.category_labels(used, 2)
    assert labels == ["Bars", "Food"]
    for missing, none in [("null", None), ("zero", 0)]:
        flags = features.category_flags(F.col("categories"), labels, missing)
        rows = rows_of(used.select("business_id", *[c.alias(n) for n, c in flags.items()]))
        assert rows == [("b1", 1, 1), ("b2", none, none), ("b3", 0, 1)]


def test_state_codes(spark):
    assert rows_of(features.state_codes(data.businesses(spark))) == [("AZ", 0), ("NV", 1), ("ON", 2)]
    many = spark.createDataFrame([(f"s{i:04d}",) for i in range(500)] * 2, "state string")
    assert rows_of(features.state_codes(many)) == [(f"s{i:04d}", i) for i in range(500)]


def test_user_and_business_features(spark):
    user = features.user_features(data.users(spark)).where("user_id = 'u1'").first().asDict()
    assert (user["u_yelping_since"], user["u_elite"], user["u_friends_cnt"], user["u_average_stars"]) == (2010, 2, 3, 3.5)
    assert len(user) == 1 + 20
    labels = [f"label{i}" for i in range(30)]
    table = features.business_features(data.businesses(spark), labels)
    assert len(table.columns) == 1 + 40
    rows = {row["business_id"]: row for row in table.collect()}
    b1, b2, b3 = rows["b1"], rows["b2"], rows["b3"]
    names = ["b_postal_code", "b_hours", "b_price", "b_noise", "b_alcohol", "b_drive_thru", "b_kids"]
    assert [b1[c] for c in names] == [ord("8"), 2, 3, 1, 0, 1, 0]
    assert [b2[c] for c in names] == [None] * 7
    assert [b3[c] for c in names] == [None, None, None, None, 1, None, None]
    assert (b1["b_category_00"], b2["b_category_00"]) == (0, None)


def test_strict_attach_raises(spark):
    table = features.user_features(data.users(spark))
    assert features.attach_user_features(data.pairs(spark), table).count() == 4
    known = data.pairs(spark).where("user_id <> 'ghost'")
    assert len(features.attach_user_features(known, table, strict=True).collect()) == 4
    with pytest.raises(Exception, match="no entity row for user_id ghost"):
        features.attach_user_features(data.pairs(spark), table, strict=True).collect()


def test_defaults_replace_missing_rows_only(spark):
    businesses, labels = data.businesses(spark), ["Bars", "Food"]
    views = features.linear_user_view(data.users(spark)), features.linear_business_view(businesses, labels)
    attached = features.attach_with_defaults(data.pairs(spark), *views, labels)
    rows = {(row["user_id"], row["business_id"]): row for row in attached.collect()}
    names = ["u_average_stars", "b_stars", "b_price", "b_state", "b_noise", "b_category_00", "b_category_01"]
    assert [rows["ghost", "new"][c] for c in names] == [2.5, 2.5, None, None, None, 0, 0]
    assert [rows["u2", "b2"][c] for c in names] == [2.0, 2.5, None, 0, None, 0, 0]
    assert [rows["u1", "b1"][c] for c in names] == [3.5, 4.0, 3, 1, 1, 1, 1]
    assert [rows["u1", "b3"][c] for c in names] == [3.5, 3.0, 2, 1, 0, 0, 1]


def test_fill_and_flags(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [(2010.0, 3.0, None, None), (None, 5.0, 2.0, nan)],
        "u_yelping_since double, u_average_stars double, friend_mean double, b_price double",
    )
    values = features.fill_values(df, df.columns)
    assert values == {"u_yelping_since": 2010.0, "u_average_stars": 4.0, "friend_mean": 4.0, "b_price": 0.0}
    assert rows_of(features.fill_mean(df, values)) == [(2010.0, 3.0, 4.0, 0.0), (2010.0, 5.0, 2.0, 0.0)]
    flagged = features.missing_flags(df, ["friend_mean", "b_price"])
    assert rows_of(flagged, "friend_mean", "b_price", "friend_mean_missing", "b_price_missing") == [
        (0.0, 0.0, 1.0, 1.0), (2.0, 0.0, 0.0, 1.0)
    ]


def test_cold_start_rule(spark):
    ruled = coldstart.cold_start_prediction(data.pairs(spark), data.users(spark), data.businesses(spark), 9.0)
    found = {(u, b): p for u, b, p in rows_of(ruled)}
    assert found["u1", "new"] == 3.5 and found["ghost", "b1"] == 4.0 and found["ghost", "new"] == 9.0


TRUTH = [("a", "x", 3.0), ("a", "y", 5.0), ("b", "x", 1.0), ("b", "y", 2.0), ("c", "x", 4.0)]
PREDICTED = [("a", "x", 3.0), ("a", "y", 4.0), ("b", "x", 5.5), ("b", "y", 2.5), ("z", "x", 1.0)]


def error_frames(spark, copies=1):
    truth = spark.createDataFrame(TRUTH * copies, "user_id string, business_id string, stars double")
    predicted = spark.createDataFrame(PREDICTED * copies, "user_id string, business_id string, prediction double")
    return truth, predicted


def test_error_report(spark):
    joined = errors.join_truth(*error_frames(spark))
    assert joined.count() == 4
    assert rows_of(errors.signed_error_totals(joined)) == [(5.0, 2, -1.0, 1)]
    assert errors.rmse(joined).first()[0] == pytest.approx(((1 + 4.5**2 + 0.25) / 4) ** 0.5)
    # An error of exactly 1 is in the first right-closed bin, one above 4 in none.
    assert [tuple(row) for row in errors.error_histogram(joined).collect()] == [
        ("0-1", 3), ("1-2", 0), ("2-3", 0), ("3-4", 0)
    ]
    assert dict(rows_of(errors.error_histogram(joined, closed="left"))) == {"0-1": 2, "1-2": 1, "2-3": 0, "3-4": 0}
    assert errors.error_histogram(joined, edges=(6, 7, 8)).count() == 0


def test_evaluation_counts_copies(spark):
    one = evaluate(*error_frames(spark)).first().asDict()
    assert (one["pairs"], one["over_count"], one["under_sum"], one["errors_0_1"]) == (4, 2, -1.0, 3)
    truth, predicted = error_frames(spark, copies=3)
    many = evaluate(truth, predicted).first().asDict()
    plain = errors.join_truth(truth, predicted)
    assert many["pairs"] == plain.count() == 36
    assert many["rmse"] == pytest.approx(one["rmse"]) and many["over_sum"] == pytest.approx(9 * one["over_sum"])


def test_evaluation_of_nothing(spark):
    truth, predicted = error_frames(spark)
    empty = evaluate(truth.where("false"), predicted).first().asDict()
    assert empty["pairs"] == 0 and empty["rmse"] is None and empty["over_sum"] == 0.0
