"""Linear models and their searches from sufficient statistics: one pass over the rows for any number of fits.

The count, the sums and the sums of products of all columns are taken once per fold. Those of a training set are the total
minus those of its held-out fold, and both the solution and the held-out error of any penalty follow from them, so nothing
else of a search grows with the rows.

Penalties are those of the usual formulations: ridge minimises |y - Xw|^2 + alpha |w|^2; lasso and elastic net minimise
|y - Xw|^2 / (2n) + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2). The intercept is free.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.models.folding import FOLD, fold_column

# A sweep of coordinate descent that moves no fitted value's scale by more than this is the last.
TOLERANCE, MOST_SWEEPS = 1e-11, 100_000


@dataclass(frozen=True)
class Moments:
    """Sums of products of 1, the columns and the label, in this order, each column minus a fixed ``shift``."""

    products: np.ndarray
    shift: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.products + other.products, self.shift)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.products - other.products, self.shift)

    @property
    def rows(self) -> float:
        return float(self.products[0, 0])

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums of products around the means: of the columns with each other, and with the label."""
        sums = self.products[0, 1:]
        around = self.products[1:, 1:] - np.outer(sums, sums) / self.rows
        return around[:-1, :-1], around[:-1, -1]

    def scaled(self, centre: np.ndarray, factor: np.ndarray) -> Moments:
        """The moments of (column - centre) * factor, without another pass."""
        map_ = np.diag(np.concatenate([[1.0], factor, [1.0]]))
        map_[1:-1, 0] = (self.shift[:-1] - centre) * factor
        return Moments(map_ @ self.products @ map_.T, np.append(np.zeros(len(factor)), self.shift[-1]))


@dataclass(frozen=True)
class Solution:
    coefficients: np.ndarray
    intercept: float

    def squared_error(self, held_out: Moments) -> float:
        """The sum of squared errors on the rows of ``held_out``."""
        w = np.concatenate([[self.intercept + self.coefficients @ held_out.shift[:-1] - held_out.shift[-1]], self.coefficients, [-1.0]])
        return max(float(w @ held_out.products @ w), 0.0)


def _gram(read: Callable[[pa.RecordBatch], np.ndarray], shift: np.ndarray, folds: int):
    """Per task and fold the sums of products, as one list. ``read`` gives the columns and the label of a batch."""
    width = len(shift) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((folds, width, width))
        for batch in batches:
            rows = np.column_stack([np.ones(batch.num_rows), read(batch)]) - np.append(0.0, shift)
            if np.isnan(rows).any():
                raise ValueError("missing values must be filled before a linear fit")
            number = batch.column(FOLD).to_numpy()
            for fold in np.unique(number):
                part = rows[number == fold]
                sums[fold] += part.T @ part
        found = np.flatnonzero(sums[:, 0, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array([sums[f].ravel().tolist() for f in found], pa.list_(pa.float64()))],
            names=["fold", "products"],
        )

    return run


def _moments(numbered: DataFrame, read: Callable[[pa.RecordBatch], np.ndarray], shift: np.ndarray, folds: int) -> list[Moments]:
    """The moments of each fold of ``numbered``, from one pass."""
    if np.isnan(shift).any():
        raise ValueError("missing values must be filled before a linear fit")
    width = len(shift) + 1
    partial = numbered.mapInArrow(_gram(read, shift, folds), "fold int, products array<double>")
    summed = (
        partial.select("fold", F.posexplode("products").alias("place", "product"))
        .groupBy("fold", "place")
        .agg(F.sum("product").alias("product"))
    )
    totals = np.zeros((folds, width * width))
    for row in summed.collect():
        totals[row["fold"], row["place"]] = row["product"]
    return [Moments(total.reshape(width, width), shift) for total in totals]


def fold_moments(
    train: DataFrame,
    features: Sequence[str],
    label: str = "stars",
    folds: int = 5,
    keys: Sequence[str] = ("user_id", "business_id"),
    fold: str | None = None,
) -> list[Moments]:
    """The moments of each fold, from one pass. ``fold`` names a column with the fold of each row, from 0 on; by default
    it follows from ``keys``. The driver gets ``folds`` small matrices, however many rows there are."""
    names = [*features, label]
    columns = [F.col(c).cast("double").alias(c) for c in names]
    first = train.select(*columns).first()
    shift = np.array(first if first is not None else np.zeros(len(names)), float)
    numbered = train.select(*columns, (F.col(fold).cast("int") if fold else fold_column(keys, folds)).alias(FOLD))

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([batch.column(name).to_numpy(zero_copy_only=False).astype(float) for name in names])

    return _moments(numbered, read, shift, folds)


def vector_moments(numbered: DataFrame, vectors: str, label: str, folds: int) -> list[Moments]:
    """As :func:`fold_moments`, of the column ``vectors``, for rows whose fold is in the column ``FOLD``."""
    rows = numbered.select(vector_to_array(vectors).alias("values"), F.col(label).cast("double").alias("label"), FOLD)
    first = rows.first()
    if first is None or first["values"] is None:
        raise ValueError("a linear fit needs rows with vectors")
    shift = np.array([*first["values"], first["label"]], float)

    def read(batch: pa.RecordBatch) -> np.ndarray:
        values, labels = batch.column("values"), batch.column("label")
        if values.null_count:
            raise ValueError("missing values must be filled before a linear fit")
        if not np.isin(batch.column(FOLD).to_numpy(), np.arange(folds)).all():
            raise ValueError(f"folds are numbered from 0 to {folds - 1}")
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return np.column_stack([flat.reshape(batch.num_rows, -1), labels.to_numpy(zero_copy_only=False).astype(float)])

    return _moments(rows, read, shift, folds)


def rows_with(moments: Moments) -> tuple[np.ndarray, float]:
    """Rows that have the same ``moments``, the label last, and the weight of each: one more than there are columns.

    Around the means they are a root of the sums of products, turned so that all rows weigh the same.
    """
    sums, rows = moments.products[0, 1:], moments.rows
    around = moments.products[1:, 1:] - np.outer(sums, sums) / rows
    squares = np.diag(moments.products)[1:]
    spread = np.sqrt(np.where(np.diag(around) > 1e-13 * squares, np.diag(around), 0.0))
    scale = np.where(spread > 0, spread, 1.0)
    values, directions = np.linalg.eigh(around / np.outer(scale, scale))
    root = np.sqrt(np.maximum(values, 0.0))[:, None] * directions.T * spread
    n = len(sums) + 1
    # Rows at right angles to each other and to a row of ones.
    turn = np.linalg.qr(np.column_stack([np.ones(n), np.eye(n)[:, : n - 1]]))[0][:, 1:]
    return sums / rows + moments.shift + turn @ root * np.sqrt(n / rows), rows / n


def _solution(moments: Moments, w: np.ndarray) -> Solution:
    means = moments.products[0, 1:] / moments.rows + moments.shift
    return Solution(w, float(means[-1] - means[:-1] @ w))


def solve_ridge(moments: Moments, alpha: float) -> Solution:
    """Columns that never vary, or repeat others, get the smallest coefficients that do."""
    xx, xy = moments.centred()
    scale = np.sqrt(np.maximum(np.diag(xx), 0))
    scale[scale == 0] = 1.0
    left = xx / np.outer(scale, scale) + np.diag(alpha / scale**2)
    return _solution(moments, np.linalg.lstsq(left, xy / scale, rcond=1e-13)[0] / scale)


def solve_elastic_net(moments: Moments, alpha: float, l1_ratio: float, start: np.ndarray | None = None) -> Solution:
    """Coordinate descent on the sums of products. ``start``: coefficients of a similar penalty."""
    xx, xy = (around / moments.rows for around in moments.centred())
    w = np.zeros(len(xy)) if start is None else start.copy()
    own = np.maximum(np.diag(xx), 0)
    varying = np.flatnonzero(own > 1e-12 * max(own.max(initial=0.0), 1e-300))
    w[np.setdiff1d(np.arange(len(w)), varying)] = 0.0
    rest = xy - xx @ w
    soft, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    spread = np.sqrt(own)
    for _ in range(MOST_SWEEPS):
        moved = 0.0
        for j in varying:
            pull = rest[j] + own[j] * w[j]
            new = np.sign(pull) * max(abs(pull) - soft, 0.0) / (own[j] + ridge)
            if (step := new - w[j]) != 0.0:
                w[j] = new
                rest -= xx[j] * step
                moved = max(moved, abs(step) * spread[j])
        if moved < TOLERANCE:
            return _solution(moments, w)
    raise ArithmeticError(f"no solution within {MOST_SWEEPS} sweeps")


def solve(moments: Moments, kind: str, point: Mapping[str, float], start: np.ndarray | None = None) -> Solution:
    """``kind`` is ridge, lasso or elastic_net; ``point`` holds ``alpha`` and, for an elastic net, ``l1_ratio``."""
    if kind == "ridge":
        return solve_ridge(moments, point["alpha"])
    if kind in ("lasso", "elastic_net"):
        return solve_elastic_net(moments, point["alpha"], 1.0 if kind == "lasso" else point["l1_ratio"], start)
    raise ValueError(f"unknown kind of penalty: {kind}")


def penalty_points(kind: str, grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """All points of a grid; neighbours differ in ``alpha``, so each starts from the one before."""
    if kind == "elastic_net":
        return [{"alpha": alpha, "l1_ratio": l1_ratio} for l1_ratio in grid["l1_ratio"] for alpha in grid["alpha"]]
    return [{"alpha": alpha} for alpha in grid["alpha"]]


def search_linear(
    moments: Sequence[Moments], grids: Mapping[str, Mapping[str, Sequence[float]]]
) -> list[tuple[str, dict[str, float], float]]:
    """Kind, point and score (negative RMSE, mean over the folds) of all points of all grids.

    A fold without rows scores nothing. Nothing is read: ``moments`` come from :func:`fold_moments`.
    """
    used = [fold for fold in moments if fold.rows > 0]
    if len(used) < 2:
        raise ValueError("a search needs rows in two folds at least")
    total = used[0]
    for fold in used[1:]:
        total = total + fold
    found = []
    for kind, grid in grids.items():
        starts: list[np.ndarray | None] = [None] * len(used)
        for point in penalty_points(kind, grid):
            errors = []
            for i, fold in enumerate(used):
                solution = solve(total - fold, kind, point, starts[i])
                starts[i] = solution.coefficients
                errors.append((solution.squared_error(fold) / fold.rows) ** 0.5)
            found.append((kind, point, -float(np.mean(errors))))
    return found


def best_points(scores: Sequence[tuple[str, dict[str, float], float]]) -> dict[str, tuple[dict[str, float], float]]:
    """The best point of each kind and its score; the first of equal ones."""
    best: dict[str, tuple[dict[str, float], float]] = {}
    for kind, point, score in scores:
        if kind not in best or score > best[kind][1]:
            best[kind] = (point, score)
    return best
