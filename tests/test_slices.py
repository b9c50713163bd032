"""Long jobs on pairs of businesses are cut into slices, with the rows of the whole."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from starcast import session
from starcast.checks import queries
from starcast.operators import similarity as sim
from starcast.plans import item_cf as plan


def tables(spark):
    """Ratings of 12 users and 9 businesses, some rated twice, and pairs to score, some of them cold."""
    chance = random.Random(5)
    rows = [(u, b, chance.randint(1, 5), n) for n, (u, b) in enumerate(
        (chance.randrange(12), chance.randrange(9)) for _ in range(70)
    )]
    pairs = [(u, b) for u in range(13) for b in range(10) if (u + b) % 3 == 0]
    ratings = spark.createDataFrame(rows, "user_id long, business_id long, stars long, n long")
    return ratings, spark.createDataFrame(pairs, "user_id long, business_id long")


@pytest.fixture
def made(monkeypatch):
    """The number of slices of each sliced job."""
    found, write = [], session.materialize_parts
    monkeypatch.setattr(
        sim, "materialize_parts", lambda spark, builds, label: found.append(len(builds)) or write(spark, builds, label)
    )
    return found


def inputs(spark):
    ratings, pairs = tables(spark)
    d = queries.Inputs(spark, "")
    d.__dict__.update(ratings=ratings, pairs=pairs, pair_table=(pairs, None), tables=sim.rating_tables(ratings, ["n"]))
    return d


def rounded(df):
    return rows_of(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


SLICED = {
    "item_similarity": lambda d: sim.item_similarity(d.item_pairs, d.tables),
    "positive_similarities": lambda d: sim.positive_similarities(sim.item_similarity(d.item_pairs, d.tables)),
    "corated": lambda d: queries.corated(d),
    "weighted_prediction": lambda d: queries.weighted_prediction(d),
    "item_cf": lambda d: plan.item_cf(d.ratings, d.pairs, ["n"]),
}


@pytest.mark.parametrize("name", SLICED)
def test_slices_have_the_rows_of_the_whole(spark, monkeypatch, made, name):
    whole = rounded(SLICED[name](inputs(spark)))
    assert set(made) <= {1}
    monkeypatch.setattr(sim, "ROWS_PER_SLICE", 100)
    assert rounded(SLICED[name](inputs(spark))) == whole and len(whole) > 20
    assert max(made) > 2


def test_a_slice_leaves_only_its_rows_on_disk(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))

    def build(n):
        return session.materialize(spark.range(n, n + 3), "on-the-way")

    with session.intermediates(spark):
        parts = session.materialize_parts(spark, [lambda: build(0), lambda: build(10)], "part")
        assert rows_of(parts) == [(0,), (1,), (10,), (11,), (12,), (2,)]
        assert sorted({path.name.rsplit("-", 1)[0] for path in tmp_path.iterdir()}) == ["part"]
    assert not list(tmp_path.iterdir())


def test_evaluation_of_sliced_predictions(spark, monkeypatch, made):
    def report():
        d = inputs(spark)
        d.__dict__["truth"] = d.pairs.select("*", (F.col("user_id") % 5 + 1).cast("double").alias("stars"))
        return rounded(queries.evaluate_item_cf(d))

    monkeypatch.setattr(queries.views, "RATING_ORDER", ["n"])
    whole = report()
    monkeypatch.setattr(sim, "ROWS_PER_SLICE", 100)
    assert report() == whole and made and min(made) > 2
