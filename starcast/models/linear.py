"""Linear models with the penalty scale of the usual least-squares formulations.

Ridge minimises |y - Xw|^2 + alpha |w|^2; lasso and elastic net minimise |y - Xw|^2 / (2n) + alpha (l1 |w|_1 +
(1 - l1) |w|^2 / 2). The estimator used here divides the squared penalty by the label's standard deviation, so both
parameters are converted. All fits use the normal equations: one pass over the rows, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, RobustScaler, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.operators.features import fill_mean
from starcast.operators.ratings import column_means

# The best parameters found by the searches in ``starcast.models.search``.
ELASTIC_NET_ALPHA, ELASTIC_NET_L1 = 1e-4, 0.4
LASSO_ALPHA = 1e-4
RIDGE_ALPHA = 1.0


@dataclass(frozen=True)
class MeanImputer:
    """Means of the training rows; columns without a single value there are left out."""

    means: dict[str, float]
    dropped: list[str]

    @property
    def columns(self) -> list[str]:
        return list(self.means)

    def transform(self, df: DataFrame) -> DataFrame:
        return fill_mean(df.drop(*self.dropped), self.means) if self.means else df.drop(*self.dropped)


def mean_imputer(train: DataFrame, cols: Sequence[str]) -> MeanImputer:
    means = column_means(train, cols).first().asDict()
    kept = {c: means[c] for c in cols if means[c] is not None}
    return MeanImputer(kept, [c for c in cols if c not in kept])


def assembler(features: Sequence[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=output)


def _regression(label: str, prediction: str, features: str, alpha: float, l1_ratio: float) -> LinearRegression:
    return LinearRegression(
        labelCol=label,
        predictionCol=prediction,
        featuresCol=features,
        regParam=alpha,
        elasticNetParam=l1_ratio,
        standardization=False,
        solver="normal",
    )


def label_scale(train: DataFrame, label: str) -> tuple[float, int]:
    """Population standard deviation and number of the labels: one pass, to be shared by the models of a table."""
    row = train.agg(F.stddev_pop(label).alias("scale"), F.count(label).alias("rows")).first()
    return row["scale"], row["rows"]


def ridge(train: DataFrame, label: str, alpha: float = RIDGE_ALPHA, prediction: str = "prediction",
          features: str = "features", scale: tuple[float, int] | None = None) -> LinearRegression:
    """``scale``: the :func:`label_scale` of ``train``, if known."""
    scale, rows = scale or label_scale(train, label)
    return _regression(label, prediction, features, alpha * scale / rows, 0.0)


def lasso(train: DataFrame, label: str, alpha: float = LASSO_ALPHA, prediction: str = "prediction",
          features: str = "features", scale: tuple[float, int] | None = None) -> LinearRegression:
    """``scale`` is not needed; it is here so that the linear models take the same arguments."""
    return _regression(label, prediction, features, alpha, 1.0)


def elastic_net(train: DataFrame, label: str, alpha: float = ELASTIC_NET_ALPHA, l1_ratio: float = ELASTIC_NET_L1,
                prediction: str = "prediction", features: str = "features",
                scale: tuple[float, int] | None = None) -> LinearRegression:
    """``scale``: the :func:`label_scale` of ``train``, if known."""
    scale, _ = scale or label_scale(train, label)
    total = alpha * l1_ratio + scale * alpha * (1 - l1_ratio)
    return _regression(label, prediction, features, total, alpha * l1_ratio / total if total else 0.0)


def fit_linear(train: DataFrame, features: Sequence[str], label: str = "stars") -> PipelineModel:
    """Ordinary least squares on columns without missing values."""
    least_squares = _regression(label, "prediction", "features", 0.0, 0.0)
    return Pipeline(stages=[assembler(features), least_squares]).fit(train)


def fit_ridge(train: DataFrame, features: Sequence[str], label: str = "stars", **params) -> PipelineModel:
    return Pipeline(stages=[assembler(features), ridge(train, label, **params)]).fit(train)


def fit_lasso(train: DataFrame, features: Sequence[str], label: str = "stars", **params) -> PipelineModel:
    return Pipeline(stages=[assembler(features), lasso(train, label, **params)]).fit(train)


def fit_elastic_net(train: DataFrame, features: Sequence[str], label: str = "stars", **params) -> PipelineModel:
    return Pipeline(stages=[assembler(features), elastic_net(train, label, **params)]).fit(train)


def robust_scaling(train: DataFrame, features: Sequence[str], output: str = "scaled") -> PipelineModel:
    """Columns minus their median, over their interquartile range where that is not 0, in the order of ``features``."""
    raw = assembler(features, f"{output}_raw")
    centred = f"{output}_centred"
    fitted = RobustScaler(inputCol=raw.getOutputCol(), outputCol=centred, withCentering=True).fit(raw.transform(train))
    # The fit gives medians and ranges; columns without a range are only centred.
    factors = [1 / width if width > 0 else 1.0 for width in fitted.range]
    fitted.set(fitted.withScaling, False)
    scale = ElementwiseProduct(inputCol=centred, outputCol=output, scalingVec=Vectors.dense(factors))
    return PipelineModel(stages=[raw, fitted, scale])


def robust_scaled(
    train: DataFrame,
    features: Sequence[str],
    estimator: Callable[[str], Estimator],
    scaling: PipelineModel | None = None,
    output: str = "scaled",
) -> PipelineModel:
    """Robust scaling, then the estimator that ``estimator`` builds for the name of the scaled column.

    Pass ``scaling`` to share one fitted scaler between several estimators.
    """
    scaling = scaling or robust_scaling(train, features, output)
    return PipelineModel(stages=[scaling, estimator(output).fit(scaling.transform(train))])
