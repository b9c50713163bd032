"""Stacking: the predictions of base models become features of a meta model, next to the original ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Model, PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.models.folding import FOLD, fold_column
from starcast.models.linear import elastic_net, label_scale, lasso, ridge, robust_scaling
from starcast.models.out_of_fold import out_of_fold_predictions
from starcast.models.trees import fit_trees
from starcast.session import materialize_training

Base = Callable[[DataFrame, Sequence[str], str, str], Model]


def linear_bases(train: DataFrame, features: Sequence[str], label: str, prefix: str) -> PipelineModel:
    """Elastic net, ridge and lasso on one robust scaling; predictions ``<prefix>0`` to ``<prefix>2``."""
    scaling = robust_scaling(train, features, f"{prefix}scaled")
    scaled = scaling.transform(train)
    stages: list[Model] = [scaling]
    scale = label_scale(train, label)
    for i, build in enumerate((elastic_net, ridge, lasso)):
        estimator = build(train, label, prediction=f"{prefix}{i}", features=f"{prefix}scaled", scale=scale)
        stages.append(estimator.fit(scaled))
    return PipelineModel(stages=stages)


def fitted_without_each_fold(
    numbered: DataFrame, features: Sequence[str], label: str, bases: Base, prefix: str, folds: int
) -> DataFrame:
    """The rows of each fold with the predictions of bases fitted on all others: a fit for each fold, for any bases."""
    parts = []
    for fold in range(folds):
        held_out = bases(numbered.where(F.col(FOLD) != fold), features, label, prefix)
        parts.append(held_out.transform(numbered.where(F.col(FOLD) == fold)))
    return reduce(DataFrame.unionByName, parts)


def fit_stacked(
    train: DataFrame,
    features: Sequence[str],
    meta: GBTRegressor,
    label: str = "stars",
    bases: Base = linear_bases,
    base_count: int = 3,
    prefix: str = "base_",
    out_of_fold: bool = False,
    folds: int = 5,
    keys: Sequence[str] = ("user_id", "business_id"),
    fold: str | None = None,
) -> PipelineModel:
    """Base models and the meta model as one pipeline.

    The meta model sees base predictions of the rows the bases were fitted on, or, with ``out_of_fold``, of rows left
    out of their fit; those of the linear bases come from two passes. ``fold`` names a column with the fold of each row, from 0 on; by default it follows from ``keys``.
    ``train`` is read many times and should be a written table.
    """
    fitted = bases(train, features, label, prefix)
    predictions = [f"{prefix}{i}" for i in range(base_count)]
    columns = [*train.columns, *predictions]
    if out_of_fold:
        numbered = train.withColumn(FOLD, F.col(fold).cast("int") if fold else fold_column(keys, folds))
        if bases is linear_bases:
            level_two = out_of_fold_predictions(numbered, features, label, prefix, folds).select(*columns)
        else:
            level_two = fitted_without_each_fold(numbered, features, label, bases, prefix, folds).select(*columns)
    else:
        level_two = fitted.transform(train).select(*columns)
    level_two = materialize_training(level_two, "stacked")
    meta_model = fit_trees(level_two, [*features, *predictions], meta)
    return PipelineModel(stages=[fitted, meta_model])
