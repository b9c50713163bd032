import types

import data
import numpy as np
import pytest
from conftest import rows_of
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from starcast.checks import queries
from starcast.models.linear import assembler, lasso, robust_scaling
from starcast.models.search import grid_search
from starcast.models import linear, search, stacking, store, trees
from starcast import session
from starcast.plans import bundle, recommenders
from starcast.session import materialize, shared_path

NAMES = ["x1", "x2", "x3"]
SMALL = {"maxIter": 4, "maxDepth": 2}


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [1.0, 3.0, 0.5] + [0.0, 2.0, -1.0]
    y = x @ [0.7, -0.2, 0.0] + 1.5 + rng.normal(scale=0.3, size=300)
    rows = [(f"u{i}", f"b{i % 40}", *map(float, x[i]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id string, business_id string, x1 double, x2 double, x3 double, stars double")
    return materialize(df, "sample"), x, y


def coefficients(model):
    last = model.stages[-1]
    return np.append(last.coefficients.toArray(), last.intercept)


def coordinate_descent(x, y, alpha, l1):
    centred, target, w = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    n = len(y)
    for _ in range(2000):
        for j in range(len(w)):
            rest = target - centred @ w + centred[:, j] * w[j]
            rho = centred[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (centred[:, j] ** 2).mean().__add__(alpha * (1 - l1))
    return np.append(w, y.mean() - x.mean(0) @ w)


def test_least_squares(spark, sample):
    df, x, y = sample
    exact = np.linalg.lstsq(np.column_stack([x, np.ones(len(y))]), y, rcond=None)[0]
    assert coefficients(linear.fit_linear(df, NAMES)) == pytest.approx(exact, abs=1e-6)


def test_ridge_penalty_scale(sample):
    df, x, y = sample
    centred = x - x.mean(0)
    w = np.linalg.solve(centred.T @ centred + 40 * np.eye(3), centred.T @ (y - y.mean()))
    exact = np.append(w, y.mean() - x.mean(0) @ w)
    assert coefficients(linear.fit_ridge(df, NAMES, alpha=40.0)) == pytest.approx(exact, abs=1e-6)


def test_lasso_and_elastic_net_penalty_scale(sample):
    df, x, y = sample
    lasso = coefficients(linear.fit_lasso(df, NAMES, alpha=0.05))
    assert lasso == pytest.approx(coordinate_descent(x, y, 0.05, 1.0), abs=1e-4)
    net = coefficients(linear.fit_elastic_net(df, NAMES, alpha=0.1, l1_ratio=0.4))
    assert net == pytest.approx(coordinate_descent(x, y, 0.1, 0.4), abs=1e-4)


def test_mean_imputer_uses_training_means_and_drops_empty_columns(spark):
    train = spark.createDataFrame([(1.0, None, None), (3.0, 4.0, None)], "a double, b double, c double")
    imputer = linear.mean_imputer(train, ["a", "b", "c"])
    assert imputer.columns == ["a", "b"] and imputer.dropped == ["c"]
    test = spark.createDataFrame([(None, float("nan"), 1.0)], "a double, b double, c double")
    assert rows_of(imputer.transform(test)) == [(2.0, 4.0)]


def test_robust_scaling_keeps_sparse_columns(spark):
    rows = [(float(i), 1.0 if i % 10 == 0 else 0.0) for i in range(101)]
    df = spark.createDataFrame(rows, "wide double, flag double")
    scaled = linear.robust_scaling(df, ["wide", "flag"]).transform(df)
    found = {row["wide"]: row["scaled"].toArray() for row in scaled.collect()}
    assert found[50.0] == pytest.approx([0.0, 1.0], abs=0.05)
    assert found[100.0][0] == pytest.approx(1.0, abs=0.05) and found[99.0][1] == 0.0


def test_boosters_learn(sample):
    df, _, y = sample
    errors = []
    for rounds in (1, 8):
        fitted = trees.fit_gbt_a(df, NAMES, maxIter=rounds, maxDepth=3, stepSize=0.5).transform(df)
        errors.append(fitted.agg(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2))).first()[0])
    assert errors[1] < errors[0] < np.var(y)
    again = trees.fit_gbt_b(df, NAMES, **SMALL), trees.fit_gbt_b(df, NAMES, **SMALL)
    assert rows_of(again[0].transform(df), "prediction") == rows_of(again[1].transform(df), "prediction")


def test_booster_defaults():
    a, b = trees.gbt_a(), trees.gbt_b()
    assert (a.getMaxIter(), a.getStepSize(), a.getMaxDepth(), a.getFeatureSubsetStrategy()) == (800, 0.05, 7, "0.3")
    assert (b.getMaxIter(), b.getStepSize(), b.getMaxDepth(), b.getMinInstancesPerNode()) == (800, 0.05, 10, 10)


@pytest.mark.parametrize("out_of_fold", [False, True])
def test_stacking(sample, out_of_fold):
    df, _, y = sample
    model = stacking.fit_stacked(df, NAMES, trees.gbt_b(**SMALL), out_of_fold=out_of_fold, folds=3)
    fitted = model.transform(df)
    assert {"base_0", "base_1", "base_2", "prediction"} <= set(fitted.columns)
    assert fitted.count() == 300
    assert fitted.agg(F.avg(F.pow(F.col("prediction") - F.col("stars"), 2))).first()[0] < np.var(y)


def test_search_and_store(spark, sample):
    df, _, _ = sample
    vectors = linear.assembler(NAMES).transform(df)
    estimator = LinearRegression(labelCol="stars", standardization=False)
    best, score, _ = search.search_penalties(vectors, estimator, "lasso", {"alpha": [1e-4, 5.0]}, folds=3)
    assert best == {"regParam": 1e-4, "elasticNetParam": 1.0} and -0.5 < score < 0
    depth, _, _ = search.grid_search(vectors, trees.gbt_a(**SMALL), {"maxDepth": [1, 3]}, folds=2)
    assert depth == {"maxDepth": 3}
    assert len(search.penalty_grid("elastic_net", search.ELASTIC_NET_GRID, 1.0, 10)) == 12
    model = linear.fit_linear(df, NAMES)
    path = shared_path(spark, "model")
    store.save_model(model, path)
    assert coefficients(store.load_model(path)) == pytest.approx(coefficients(model))


def inputs(spark):
    return data.ratings(spark), data.users(spark), data.businesses(spark), data.pairs(spark)


def test_linear_recommender_scores_every_pair(spark):
    scored = rows_of(recommenders.linear_recommender(*inputs(spark)))
    assert [row[:2] for row in scored] == sorted(data.PAIRS, key=repr)
    assert all(row[2] is not None for row in scored)


def test_hybrid_recommender(spark):
    scored = {row[:2]: row[2] for row in rows_of(
        recommenders.hybrid_recommender(*inputs(spark), ["n"], SMALL, {**SMALL, "minInstancesPerNode": 1})
    )}
    assert set(scored) == set(data.PAIRS)
    assert scored["u1", "new"] == 3.5 and scored["ghost", "b1"] == 4.0
    assert scored["ghost", "new"] == pytest.approx(25 / 8)
    assert all(1 <= scored[pair] <= 5 for pair in [("u1", "b3"), ("u2", "b2"), ("u1", "b1")])


@pytest.mark.parametrize("stats_from", ["train", "self"])
def test_stacked_recommender(spark, stats_from):
    small = {**SMALL, "maxIter": 2}
    scored = rows_of(recommenders.stacked_recommender(
        *inputs(spark), ["n"], small, small, small, stats_from=stats_from
    ))
    assert [row[:2] for row in scored] == sorted(data.PAIRS, key=repr)
    assert all(1 <= row[2] <= 5 for row in scored)


def test_pair_features_have_61_columns_on_full_width(spark):
    made = recommenders.pair_features(*inputs(spark), ["n"])
    labels = len([c for c in made.names if c.startswith("b_category_")])
    assert labels == 3 and len(made.names) == 20 + 10 + labels + 1
    assert made.train.count() == 7 and made.known.count() == 3


def test_train_job(spark):
    ratings, users, businesses, pairs = inputs(spark)
    more = spark.createDataFrame(
        [("u1", "b3", 4.0, 9), ("u2", "b2", 3.0, 10), ("u3", "b2", 1.0, 11)],
        "user_id string, business_id string, stars double, n int",
    )
    report = bundle.train_job(
        ratings.unionByName(more), users, businesses, pairs, shared_path(spark, "models"), ["n"], SMALL,
        {**SMALL, "minInstancesPerNode": 1}, {"maxDepth": [1, 2]}, None, folds=2,
    )
    assert set(report.searches) == {"gbt_a"} and report.searches["gbt_a"][1] < 0
    for errors in report.errors.values():
        assert len(errors) == SMALL["maxIter"] and errors == sorted(errors, reverse=True)
    assert store.load_model(report.path_a).stages and store.load_model(report.path_b).stages


def test_feature_columns_can_be_chosen(spark):
    with pytest.raises(ValueError, match="no such features: junk"):
        recommenders.linear_recommender(*inputs(spark), columns=["junk"])


def test_folds_can_be_chosen(spark):
    rows = spark.createDataFrame(
        [(float(i), float(2 * i + i % 3), i % 4) for i in range(24)], "x double, stars double, part int"
    )
    vectors = assembler(["x"]).transform(rows)
    best, score, fitted = grid_search(vectors, lasso(vectors, "stars"), [{"regParam": 0.0}], folds=4, fold="part")
    errors = []
    for part in range(4):
        train, test = (np.array(rows.where(f"part {op} {part}").select("x", "stars").collect()) for op in ("<>", "="))
        slope, shift = np.polyfit(train[:, 0], train[:, 1], 1)
        errors.append(np.sqrt(np.mean((slope * test[:, 0] + shift - test[:, 1]) ** 2)))
    assert score == pytest.approx(-np.mean(errors), abs=1e-6)


def test_one_scaler_fit_keeps_the_order_of_columns(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 10.0), (2.0, 5.0, 30.0), (3.0, 5.0, 20.0), (4.0, 5.0, 0.0)], "a double, b double, c double")
    scaled = robust_scaling(rows, ["a", "b", "c"]).transform(rows).select("scaled").collect()
    assert [list(r.scaled)[1] for r in scaled] == [0.0] * 4
    a = np.array([list(r.scaled)[0] for r in scaled])
    assert np.allclose(np.diff(sorted(a)), np.diff(sorted(a))[0]) and len(set(a)) == 4


@pytest.mark.parametrize("name, points", [("ridge", 7), ("elastic_net", 12), ("lasso", 4)])
def test_queries_search_full_penalty_grids(spark, monkeypatch, name, points):
    rows = spark.range(40).selectExpr("id AS user_id", "id AS business_id", "double(id % 5 + 1) AS stars", "double(id % 7) AS x")
    d = types.SimpleNamespace(spark=spark, model_rows=(rows, ["x"]))
    searched = []
    monkeypatch.setattr(search, "CrossValidator", lambda **options: searched.append(options) or CrossValidator(**options))
    assert f"grid_search_{name}" in queries.QUERIES
    found = getattr(queries, f"grid_search_{name}")(d).collect()
    assert [r.search for r in found] == [name] and found[0].score < 0
    assert [(len(o["estimatorParamMaps"]), o["numFolds"]) for o in searched] == [(points, 5)]


def test_errors_of_a_booster_before_and_after_it_scored(spark, sample):
    rows, _, y = sample
    vectors = assembler(NAMES).transform(rows).select("stars", "features")
    model = trees.fit_on_vectors(vectors, NAMES, trees.gbt_a(prediction="p", **SMALL))
    fresh = recommenders.error_per_tree(model, vectors)
    predicted = [row["p"] for row in model.transform(rows).orderBy("user_id").select("p").collect()]
    actual = [row["stars"] for row in rows.orderBy("user_id").select("stars").collect()]
    assert fresh[-1] == pytest.approx(np.sqrt(np.mean((np.array(predicted) - actual) ** 2)))
    assert len(fresh) == SMALL["maxIter"] and recommenders.error_per_tree(model, vectors) == pytest.approx(fresh)


def test_a_booster_reads_a_bounded_number_of_rows_a_task(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TRAINING_FILE", 10)
    rows = spark.range(0, 95, 1, 1).selectExpr("double(id % 7) AS x", "double(id % 7 % 3) AS stars")
    train = session.materialize_training(rows, "train")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with session.a_task_per_file(spark):
        sizes = [n for n in train.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(sizes) == 95 and max(sizes) == 10
    seen = []
    fit = trees.Pipeline.fit
    monkeypatch.setattr(trees.Pipeline, "fit", lambda own, df: seen.append(df.rdd.getNumPartitions()) or fit(own, df))
    trees.fit_gbt_b(train, ["x"], **SMALL)
    assert seen == [10] and spark.conf.get("spark.sql.files.openCostInBytes") == before
