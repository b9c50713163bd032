import math
import random
import types
from collections import defaultdict

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from starcast.checks import queries
from starcast.operators import similarity as sim
from starcast.operators import skew
from starcast.operators.ratings import business_mean, latest_rating, rating_facts
from starcast.plans import item_cf as plan

GOLDEN = [
    ("U1", "I1", 2), ("U2", "I1", 3), ("U4", "I1", 5), ("U1", "I2", 1), ("U3", "I2", 4), ("U4", "I2", 3),
    ("U2", "I3", 5), ("U3", "I3", 2), ("U4", "I3", 1), ("U1", "I4", 3), ("U2", "I4", 2), ("U3", "I4", 3),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(u, b, float(s), i) for i, (u, b, s) in enumerate(rows)], "user_id string, business_id string, stars double, n int"
    )


def pairs_frame(spark, rows):
    return spark.createDataFrame(rows, "user_id string, business_id string")


def brute_force(rows, pairs):
    """Straight from the definition, in exact integers where a sign decides."""
    rows = [(u, b, round(2 * s)) for u, b, s in rows]
    of_user, of_business, all_rows = defaultdict(dict), defaultdict(dict), defaultdict(list)
    for u, b, s in rows:
        of_user[u][b] = s
        of_business[b][u] = s
        all_rows[b].append(s)

    def similarity(i, j):
        dot = square_i = square_j = 0
        for u in of_business[i].keys() & of_business[j].keys():
            d_i = len(all_rows[i]) * of_business[i][u] - sum(all_rows[i])
            d_j = len(all_rows[j]) * of_business[j][u] - sum(all_rows[j])
            dot, square_i, square_j = dot + d_i * d_j, square_i + d_i**2, square_j + d_j**2
        return dot / math.sqrt(square_i * square_j) if square_i and square_j else 1.0

    result = []
    for u, i in pairs:
        rated, raters = of_user.get(u), of_business.get(i)
        if not rated and not raters:
            score = 5.0
        elif not rated:
            score = sum(raters.values()) / len(raters)
        else:
            score = sum(rated.values()) / len(rated)
            if raters:
                near = [(s, similarity(i, j)) for j, s in rated.items()]
                weight = sum(w for _, w in near if w > 0)
                if weight:
                    score = sum(s * w for s, w in near if w > 0) / weight
        result.append((u, i, round(score / 2, 9)))
    return sorted(result, key=repr)


def scored(spark, rows, pairs):
    result = plan.item_cf(frame(spark, rows), pairs_frame(spark, pairs), ["n"])
    return rows_of(result.withColumn("prediction", F.round("prediction", 9)))


def test_golden_similarities(spark):
    tables = sim.rating_tables(frame(spark, GOLDEN), ["n"])
    given = spark.createDataFrame([("I2", j) for j in ("I1", "I3", "I4", "I2")], "item_id string, other_id string")
    found = {row["other_id"]: round(row["similarity"], 6) for row in sim.item_similarity(given, tables).collect()}
    assert found == {"I1": 0.765705, "I3": -0.585491, "I4": -0.110432, "I2": 1.0}
    positive = sim.positive_similarities(sim.item_similarity(given, tables))
    assert {row["other_id"] for row in positive.collect()} == {"I1", "I2"}


def test_no_common_rater_counts_as_similar(spark):
    rows = [("a", "x", 5), ("b", "y", 1), ("b", "z", 2), ("c", "z", 4)]
    tables = sim.rating_tables(frame(spark, rows), ["n"])
    given = spark.createDataFrame([("x", "y"), ("y", "z")], "item_id string, other_id string")
    found = rows_of(sim.item_similarity(given, tables), "item_id", "other_id", "common", "similarity")
    # y has one rating, so its deviations are all zero.
    assert found == [("x", "y", 0, 1.0), ("y", "z", 1, 1.0)]


def test_cold_branches(spark):
    pairs = [("U9", "I9"), ("U9", "I1"), ("U1", "I9"), ("U1", "I1")]
    found = {(u, i): p for u, i, p in scored(spark, GOLDEN, pairs)}
    assert found[("U9", "I9")] == 2.5
    assert found[("U9", "I1")] == round(10 / 3, 9)
    assert found[("U1", "I9")] == 2.0
    assert sorted(scored(spark, GOLDEN, pairs), key=repr) == brute_force(GOLDEN, pairs)


def test_all_similarities_negative(spark):
    # x and y are rated in opposite ways by the same users, and "me" rated only y.
    rows = [("a", "x", 5), ("b", "x", 1), ("a", "y", 1), ("b", "y", 5), ("me", "y", 3)]
    assert scored(spark, rows, [("me", "x")]) == [("me", "x", 3.0)] == brute_force(rows, [("me", "x")])


def test_repeated_ratings_and_pairs(spark):
    rows = [*GOLDEN, ("U1", "I1", 5), ("U1", "I1", 4), ("U2", "I2", 4.5)]
    pairs = [("U1", "I2"), ("U1", "I2"), ("U2", "I4"), ("U3", "I1")]
    assert scored(spark, rows, pairs) == brute_force(rows, pairs)
    assert latest_rating(frame(spark, rows), ["n"]).where("user_id = 'U1' and business_id = 'I1'").first()["stars"] == 4
    means = {row["business_id"]: row["mean_stars"] for row in business_mean(frame(spark, rows)).collect()}
    assert means["I1"] == pytest.approx(19 / 5)


def random_rows(seed, n=260):
    """Ratings with one user and one business that each hold about a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        user = "hot" if rng.random() < 0.3 else f"u{rng.randrange(25)}"
        business = "hot" if rng.random() < 0.3 else f"b{rng.randrange(25)}"
        rows.append((user, business, rng.randrange(2, 11) / 2))
    pairs = [(f"u{rng.randrange(28)}", f"b{rng.randrange(28)}") for _ in range(25)]
    return rows, [*pairs, ("hot", "hot"), ("hot", "b1"), ("u1", "hot"), ("hot", "b27"), ("hot", "b1")]


def test_against_brute_force(spark):
    rows, pairs = random_rows(1)
    assert scored(spark, rows, pairs) == brute_force(rows, pairs)


def test_cut_keys_change_nothing(spark, monkeypatch):
    rows, pairs = random_rows(2)
    for module in (sim, plan):
        monkeypatch.setattr(module, "ROWS_PER_JOIN_BLOCK", 3)
    assert scored(spark, rows, pairs) == brute_force(rows, pairs)


def test_string_free_of_order_needs_no_order(spark):
    facts = rating_facts(frame(spark, [("a", "x", 2), ("a", "x", 4.5)]))
    assert rows_of(facts, "user_id", "half", "rows", "row_halves") == [("a", 9, 2, 13)]


def test_plan_has_no_cross_join_and_no_python(spark):
    result = plan.item_cf(frame(spark, GOLDEN), pairs_frame(spark, [("U1", "I2")]), ["n"])
    text = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "Python" not in text and "BroadcastNestedLoopJoin" not in text


def test_huge_rater_counts_stay_exact(spark):
    # Totals of two businesses with 10^11 rows each, and sums over as many common raters.
    n = 10**11
    row = (n, 6 * n, n, 6 * n, n, 6 * n, 6 * n, 52 * n, 52 * n, 20 * n)
    names = ["n_i", "t_i", "n_j", "t_j", "common", "s_i", "s_j", "s_ii", "s_jj", "s_ij"]
    df = spark.createDataFrame([row], ", ".join(f"{name} long" for name in names))
    assert df.select(sim.similarity_column().alias("s")).first()["s"] == pytest.approx(-1.0)


def common_raters(rows, pairs):
    latest = {(u, b): s for u, b, s in rows}
    raters = {b: {u for u, i in latest if i == b} for _, b, _ in rows}
    return sorted(
        ((i, j, u, 2 * latest[u, i], 2 * latest[u, j]) for i, j in pairs for u in raters[i] & raters[j]), key=repr
    )


@pytest.mark.parametrize("walked", [None, True, False])
def test_common_raters_either_way(spark, monkeypatch, walked):
    rows = list({(u, b): (u, b, s) for u, b, s in random_rows(3)[0]}.values())
    names = sorted({b for _, b, _ in rows})
    # Either business may come first, and a pair may hold one business twice.
    pairs = [(i, j) for n, i in enumerate(names) for j in names[n % 3 :: 3]]
    tables = sim.rating_tables(frame(spark, rows), ["n"])
    asked = sim.item_pairs_table(spark.createDataFrame(pairs, "small_id string, large_id string"))
    if walked is not None:
        forced = sim.Routes(tables.users.select("user_id", F.lit(walked).alias("walked")), walked, not walked)
        monkeypatch.setattr(sim, "corated_routes", lambda *_: forced)
    assert rows_of(sim.corated(asked, tables)) == common_raters(rows, pairs)


def test_pairs_without_a_common_rater_are_not_expanded(spark):
    # Ten users of two ratings each; every pair of businesses is asked for. A user of many ratings is probed instead.
    rows = [(f"u{n}", f"b{n}{side}", 3) for n in range(10) for side in "xy"]
    names = [b for _, b, _ in rows]
    pairs = [(i, j) for i in names for j in names if i < j]
    long = [("long", f"c{n}", 3) for n in range(40)]
    tables = sim.rating_tables(frame(spark, [*rows, *long]), ["n"])
    asked = sim.item_pairs_table(spark.createDataFrame([*pairs, ("c1", "c2")], "small_id string, large_id string"))
    found = sim.corated_routes(asked, tables)
    assert (found.any_walked, found.any_probing) == (True, True)
    walked = {row["user_id"]: row["walked"] for row in found.users.collect()}
    # b9x and b9y share a rater whose ratings begin one pair, and the pairs of that history are three.
    assert walked == {f"u{n}": n < 9 for n in range(10)} | {"long": False}
    assert len(rows_of(sim.corated(asked, tables))) == 11


def test_means_are_looked_up_before_pairs_meet_the_ratings_of_their_user(spark):
    ratings = frame(spark, GOLDEN + [("U1", "I1", 4), ("U5", "I5", 3)])
    pairs = pairs_frame(spark, [("U1", "I3"), ("U2", "I3"), ("U1", "new"), ("ghost", "I1"), ("U5", "I1")])
    # There is no table of candidates here.
    d = types.SimpleNamespace(ratings=ratings, pair_table=(pairs, None), tables=sim.rating_tables(ratings, ["n"]))
    means = {"I1": 3.5, "I2": 2.666667, "I3": 2.666667, "I4": 2.666667, "I5": 3.0}
    asked = {("I3", other) for other in ("I1", "I2", "I4", "I3")} | {("I1", "I5")}
    expected = sorted((item, other, means[item], means[other]) for item, other in asked)
    assert queries.average_lookup(d).columns == ["item_id", "other_id", "item_mean", "other_mean"]
    assert rows_of(queries.average_lookup(d)) == expected
