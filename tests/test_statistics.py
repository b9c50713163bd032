"""Linear searches from sufficient statistics, and boosters scored by prefix, against separate fits."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from starcast.models import leaves, linear, search, stacking, statistics, store, trees
from starcast.models.folding import FOLD
from starcast.models.out_of_fold import out_of_fold_predictions
from starcast.session import materialize, shared_path

NAMES = ["x1", "x2", "x3", "flat", "year"]
GRIDS = {"ridge": {"alpha": [1e-4, 3.0, 100]}, "lasso": {"alpha": [1e-3, 0.05]}, "elastic_net": {"alpha": [0.02], "l1_ratio": [0.3, 0.6]}}


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)) * [1.0, 3.0, 0.5] + [0.0, 2.0, -1.0]
    year = rng.integers(2004, 2018, 400)
    y = x @ [0.7, -0.2, 0.0] + 0.05 * (year - 2010) + rng.normal(scale=0.3, size=400)
    rows = [(i, i % 7, *map(float, x[i]), 1.0, float(year[i]), float(y[i]), i % 4) for i in range(400)]
    columns = "user_id long, business_id long, x1 double, x2 double, x3 double, flat double, year double, stars double, part int"
    return materialize(spark.createDataFrame(rows, columns).repartition(3), "sample")


def fit_and_score(train, held_out, kind, point):
    if kind == "ridge":
        model = linear.fit_ridge(train, NAMES, alpha=point["alpha"])
    elif kind == "lasso":
        model = linear.fit_lasso(train, NAMES, alpha=point["alpha"])
    else:
        model = linear.fit_elastic_net(train, NAMES, alpha=point["alpha"], l1_ratio=point["l1_ratio"])
    return RegressionEvaluator(labelCol="stars").evaluate(model.transform(held_out))


def test_scores_equal_separate_fits_per_fold(sample):
    moments = statistics.fold_moments(sample, NAMES, folds=4, fold="part")
    assert [m.rows for m in moments] == [100.0] * 4
    for kind, point, score in statistics.search_linear(moments, GRIDS):
        errors = [
            fit_and_score(sample.where(F.col("part") != k), sample.where(F.col("part") == k), kind, point) for k in range(4)
        ]
        assert score == pytest.approx(-np.mean(errors), abs=1e-6)


def test_ridge_scores_equal_the_closed_form(sample):
    moments = statistics.fold_moments(sample, NAMES, folds=4, fold="part")
    rows = sample.select(*NAMES, "stars", "part").toPandas()
    for _, point, score in statistics.search_linear(moments, {"ridge": {"alpha": [0.5, 100]}}):
        errors = []
        for k in range(4):
            fit, rest = rows[rows["part"] != k], rows[rows["part"] == k]
            means, mean = fit[NAMES].mean(), fit["stars"].mean()
            x, y = (fit[NAMES] - means).to_numpy(), (fit["stars"] - mean).to_numpy()
            w = np.linalg.solve(x.T @ x + point["alpha"] * np.eye(len(NAMES)), x.T @ y)
            errors.append(np.sqrt(np.mean((rest["stars"] - mean - (rest[NAMES] - means) @ w) ** 2)))
        assert score == pytest.approx(-np.mean(errors), abs=1e-9)


def test_best_point_of_full_grids(sample):
    moments = statistics.fold_moments(sample, NAMES)
    grids = {"ridge": search.RIDGE_GRID, "lasso": search.LASSO_GRID, "elastic_net": search.ELASTIC_NET_GRID}
    scores = statistics.search_linear(moments, grids)
    assert len(scores) == 23
    vectors = linear.assembler(NAMES).transform(sample)
    estimator = linear.elastic_net(vectors, "stars")
    for kind, (point, score) in statistics.best_points(scores).items():
        found, other, _ = search.search_penalties(vectors, estimator, kind, grids[kind])
        # That search scales the penalty by all labels, not by those of the fold.
        assert score == pytest.approx(other, abs=1e-5)
        if kind == "lasso":
            assert found["regParam"] == point["alpha"]


def test_moments_of_scaled_columns(sample):
    total = sum_of(statistics.fold_moments(sample, NAMES))
    centre, factor = np.array([1.0, 2.0, 3.0, 1.0, 2010.0]), np.array([2.0, 0.5, 1.0, 1.0, 0.1])
    direct = sample.select("stars", *[((F.col(n) - c) * f).alias(n) for n, c, f in zip(NAMES, centre.tolist(), factor.tolist())])
    made = statistics.solve_ridge(total.scaled(centre, factor), 5.0)
    fitted = linear.fit_ridge(direct, NAMES, alpha=5.0).stages[-1]
    assert made.coefficients == pytest.approx(fitted.coefficients.toArray(), abs=1e-6)
    assert made.intercept == pytest.approx(fitted.intercept, abs=1e-5)


def sum_of(moments):
    total = moments[0]
    for more in moments[1:]:
        total = total + more
    return total


def test_missing_values_and_empty_tables(spark, sample):
    with pytest.raises(Exception, match="missing values"):
        statistics.fold_moments(sample.withColumn("x1", F.lit(None).cast("double")), NAMES)
    with pytest.raises(ValueError, match="two folds"):
        statistics.search_linear(statistics.fold_moments(sample.limit(0), NAMES), GRIDS)
    with pytest.raises(ValueError, match="unknown kind"):
        statistics.solve(sum_of(statistics.fold_moments(sample, NAMES)), "cubic", {"alpha": 1.0})


def test_prefix_scores_equal_separate_fits(sample):
    vectors = materialize(linear.assembler(NAMES).transform(sample), "vectors")
    grid = {"maxIter": [2, 5], "maxDepth": [1, 3]}
    best, score, scores = search.search_boosters(vectors, trees.gbt_a(stepSize=0.3), grid, folds=4, fold="part")
    assert len(scores) == 4 and score == max(s for _, s in scores)
    for point, found in scores:
        _, single, _ = search.grid_search(vectors, trees.gbt_a(stepSize=0.3, **point), [{}], folds=4, fold="part")
        assert found == pytest.approx(single, abs=1e-9)
    assert best == max(scores, key=lambda s: s[1])[0]
    by_key, _, _ = search.search_boosters(vectors, trees.gbt_a(maxIter=2), {"maxDepth": [1, 3]}, folds=2)
    assert set(by_key) == {"maxDepth"}


def test_leaf_penalty_of_one_tree(sample):
    """Each leaf's value is the sum of its residuals over its rows plus the penalty."""
    booster = trees.fit_gbt_b(sample, NAMES, maxIter=1, maxDepth=3, minInstancesPerNode=1)
    grown = booster.transform(sample).select("user_id", "stars", F.col("prediction").alias("leaf"))
    for l2, model in zip([0.5, 20.0], leaves.fit_leaf_penalties(booster, sample, [0.5, 20.0])):
        found = model.transform(sample).select("user_id", "prediction").join(grown, "user_id").toPandas()
        by_leaf = found.groupby("leaf")["stars"].agg(["count", "mean"])
        weight = by_leaf["count"] / (by_leaf["count"] + l2)
        shift = (weight * by_leaf["mean"]).sum() / weight.sum()
        expected = found["leaf"].map(shift + weight * (by_leaf["mean"] - shift))
        assert found["prediction"].to_numpy() == pytest.approx(expected.to_numpy(), abs=1e-6)


def test_leaf_penalty_shrinks_a_booster_and_is_saved(spark, sample):
    booster = trees.fit_gbt_b(sample, NAMES, maxIter=4, maxDepth=2, minInstancesPerNode=1)
    weak, strong = leaves.fit_leaf_penalties(booster, sample, [0.01, 1e6])
    spread = [m.transform(sample).agg(F.stddev("prediction")).first()[0] for m in (booster, weak, strong)]
    assert spread[2] < 0.05 * spread[1] and spread[1] > 0.5 * spread[0]
    path = shared_path(spark, "leaves")
    store.save_model(weak, path)
    again = store.load_model(path).transform(sample).select("user_id", F.col("prediction").alias("again"))
    both = weak.transform(sample).join(again, "user_id").agg(F.max(F.abs(F.col("prediction") - F.col("again"))))
    assert both.first()[0] == 0


def test_out_of_fold_predictions_equal_a_fit_for_each_fold(sample):
    numbered = materialize(sample.withColumn(FOLD, F.col("part").cast("int")), "numbered")
    names = ["x1", "x2", "x3", "year"]
    found = out_of_fold_predictions(numbered, names, "stars", "base_", 4).toPandas().set_index("user_id")
    each = stacking.fitted_without_each_fold(numbered, names, "stars", stacking.linear_bases, "base_", 4)
    each = each.select("user_id", "base_0", "base_1", "base_2").toPandas().set_index("user_id")
    assert len(found) == 400 and set(numbered.columns) < {*found.columns, "user_id"}
    for name in ("base_0", "base_1", "base_2"):
        assert found[name].to_numpy() == pytest.approx(each.loc[found.index, name].to_numpy(), abs=2e-4)


def test_weighted_rows_have_the_moments_of_all_rows(sample):
    numbered = linear.assembler(NAMES).transform(sample).withColumn(statistics.FOLD, F.expr("int(user_id % 2)"))
    for number, moments in enumerate(statistics.vector_moments(numbered, "features", "stars", 2)):
        own = numbered.where(F.col(statistics.FOLD) == number).select(*NAMES, "stars").toPandas().to_numpy(float)
        few, weight = statistics.rows_with(moments)
        assert len(few) == len(NAMES) + 2 and weight * len(few) == pytest.approx(len(own))
        assert few.mean(0) == pytest.approx(own.mean(0))
        assert np.cov(few.T, bias=True) == pytest.approx(np.cov(own.T, bias=True))


def test_a_penalty_search_reads_its_rows_once_and_finds_what_fits_on_all_rows_find(sample, monkeypatch):
    vectors = linear.assembler(NAMES).transform(sample)
    estimator, read = linear.elastic_net(vectors, "stars"), []
    plain = search.grid_search
    monkeypatch.setattr(search, "grid_search", lambda train, *a, **o: read.append(train.count()) or plain(train, *a, **o))
    for kind, grid in (("ridge", search.RIDGE_GRID), ("elastic_net", search.ELASTIC_NET_GRID)):
        best, score, fitted = search.search_penalties(vectors, estimator, kind, grid)
        scale, rows = linear.label_scale(vectors, "stars")
        points = search.penalty_grid(kind, grid, scale, rows * 4 // 5)
        found, other, slow = plain(vectors, estimator, points)
        assert found == best and other == pytest.approx(score, abs=1e-7)
        assert fitted.avgMetrics == pytest.approx(slow.avgMetrics, abs=1e-7)
        assert list(fitted.bestModel.coefficients) == pytest.approx(list(slow.bestModel.coefficients), abs=1e-6)
    assert read == [5 * (len(NAMES) + 2)] * 2
