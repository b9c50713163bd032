"""Boosted regression trees.

The trainer finds splits from histograms that executors build and merge, and keeps its own binned copy of the rows,
so the input is read a fixed number of times however many trees are grown.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame

from starcast.models.linear import assembler
from starcast.session import a_task_per_file

# The parameters of the two boosters.
TREES, STEP = 800, 0.05
DEPTH_A, COLUMN_SHARE_A = 7, "0.3"
DEPTH_B, LEAF_ROWS_B = 10, 10
SEED = 7


def gbt_a(label: str = "stars", prediction: str = "prediction", **params) -> GBTRegressor:
    """Medium trees that see a sample of the columns at each split."""
    settings = dict(
        maxIter=TREES, stepSize=STEP, maxDepth=DEPTH_A, featureSubsetStrategy=COLUMN_SHARE_A, seed=SEED,
        labelCol=label, predictionCol=prediction,
    )
    return GBTRegressor(**(settings | params))


def gbt_b(label: str = "stars", prediction: str = "prediction", **params) -> GBTRegressor:
    """Deep trees. A least number of rows per leaf does the work of a penalty on leaf values."""
    settings = dict(
        maxIter=TREES, stepSize=STEP, maxDepth=DEPTH_B, minInstancesPerNode=LEAF_ROWS_B, seed=SEED,
        labelCol=label, predictionCol=prediction,
    )
    return GBTRegressor(**(settings | params))


def fit_trees(train: DataFrame, features: Sequence[str], trees: GBTRegressor) -> PipelineModel:
    column = f"{trees.getPredictionCol()}_features"
    with a_task_per_file(train.sparkSession):
        return Pipeline(stages=[assembler(features, column), trees.copy().setFeaturesCol(column)]).fit(train)


def fit_on_vectors(vectors: DataFrame, features: Sequence[str], trees: GBTRegressor) -> PipelineModel:
    """As :func:`fit_trees`, for training rows whose ``features`` column is assembled already.

    The trainer reads its input several times, so boosters that share their columns share one written table of vectors.
    """
    with a_task_per_file(vectors.sparkSession):
        fitted = trees.copy().setFeaturesCol("features").fit(vectors)
    column = f"{trees.getPredictionCol()}_features"
    return PipelineModel(stages=[assembler(features, column), fitted.setFeaturesCol(column)])


def fit_gbt_a(train: DataFrame, features: Sequence[str], label: str = "stars", **params) -> PipelineModel:
    return fit_trees(train, features, gbt_a(label, **params))


def fit_gbt_b(train: DataFrame, features: Sequence[str], label: str = "stars", **params) -> PipelineModel:
    return fit_trees(train, features, gbt_b(label, **params))
