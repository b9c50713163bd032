"""Out-of-fold predictions of the linear base models from two passes, however many folds and models there are.

The first pass takes the sums of products and the quartiles; the solution that leaves a fold out follows from the sums of
the others, on columns scaled by the quartiles of the others. The second pass applies each row's own solutions to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starcast.models.folding import FOLD
from starcast.models.linear import ELASTIC_NET_ALPHA, ELASTIC_NET_L1, LASSO_ALPHA, RIDGE_ALPHA
from starcast.models.statistics import Moments, fold_moments, solve

#: The base models in the order of their predictions.
BASES = [
    ("elastic_net", {"alpha": ELASTIC_NET_ALPHA, "l1_ratio": ELASTIC_NET_L1}),
    ("ridge", {"alpha": RIDGE_ALPHA}),
    ("lasso", {"alpha": LASSO_ALPHA}),
]
QUARTILE_ACCURACY = 10_000


def _quartiles(numbered: DataFrame, features: Sequence[str], folds: int) -> np.ndarray:
    """By fold, feature and quartile: the quartiles of all rows outside the fold."""
    columns = [
        F.expr(f"percentile_approx(`{name}`, array(0.25, 0.5, 0.75), {QUARTILE_ACCURACY}) filter (where {FOLD} <> {fold})").alias(
            f"q_{fold}_{i}"
        )
        for fold in range(folds)
        for i, name in enumerate(features)
    ]
    row = numbered.agg(*columns).first()
    empty = [0.0, 0.0, 0.0]
    return np.array([[row[f"q_{fold}_{i}"] or empty for i in range(len(features))] for fold in range(folds)], float)


def solutions_without(moments: Sequence[Moments], quartiles: np.ndarray) -> np.ndarray:
    """By fold and base model: the coefficients of the columns as they are, then the intercept, without that fold."""
    total = moments[0]
    for more in moments[1:]:
        total = total + more
    width = quartiles[:, :, 2] - quartiles[:, :, 0]
    factors = np.where(width > 0, 1 / np.where(width > 0, width, 1.0), 1.0)
    found = np.zeros((len(moments), len(BASES), quartiles.shape[1] + 1))
    for fold, own in enumerate(moments):
        rest = total - own
        if rest.rows == 0 or own.rows == 0:
            continue
        centre, factor = quartiles[fold, :, 1], factors[fold]
        scaled = rest.scaled(centre, factor)
        for base, (kind, point) in enumerate(BASES):
            solution = solve(scaled, kind, point)
            raw = solution.coefficients * factor
            found[fold, base] = np.append(raw, solution.intercept - raw @ centre)
    return found


def out_of_fold_predictions(
    numbered: DataFrame, features: Sequence[str], label: str, prefix: str, folds: int
) -> DataFrame:
    """``numbered``, which has the fold of each row, with ``<prefix>0`` to ``<prefix>2`` from models without that fold."""
    moments = fold_moments(numbered, features, label, folds, fold=FOLD)
    solutions = solutions_without(moments, _quartiles(numbered, features, folds))
    names = [f"{prefix}{i}" for i in range(len(BASES))]
    schema = T.StructType([*numbered.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in features]
            rows = np.column_stack([*columns, np.ones(batch.num_rows)])
            own = solutions[batch.column(FOLD).to_numpy()]
            predicted = np.einsum("rbc,rc->rb", own, rows)
            added = [pa.array(predicted[:, i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return numbered.mapInArrow(run, schema)
