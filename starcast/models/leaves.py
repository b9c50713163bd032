"""A penalty on the leaf values of a booster: its trees are kept, and their leaf values fitted anew by ridge regression.

The learner here has no such penalty. So each row becomes the set of leaves that it falls into, one a tree, and all leaf
values are solved together: |y - b - sum of leaf values|^2 + l2 |leaf values|^2 is minimised over the rows where they lie. For
one tree that is the sum of a leaf's residuals over its number of rows plus ``l2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.models.linear import ridge
from starcast.models.stages import Stage
from starcast.session import materialize

L2_GRID = [0.1, 1, 3, 10]  # Fixed values: the searched penalties.
# Up to so many leaves the sums of products are solved at once; beyond, by gradient steps over the rows.
MOST_DIRECT = 2048


class LeafNames(Stage, HasInputCol, HasOutputCol):
    """The leaf of each tree as a name: tree and number, as in ``3:17``."""

    @keyword_only
    def __init__(self, *, inputCol: str = None, outputCol: str = None):
        super().__init__()
        self._keep(self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def name(leaf, tree):
            return F.concat_ws(":", tree, leaf.cast("int"))

        return dataset.withColumn(self.getOutputCol(), F.transform(vector_to_array(self.getInputCol()), name))


def leaf_names(trees: GBTRegressionModel) -> list[str]:
    """The names of all leaves. A tree whose nodes have two children each or none has one leaf more than inner nodes."""
    return [f"{t}:{leaf}" for t, tree in enumerate(trees.trees) for leaf in range((tree.numNodes + 1) // 2)]


def fit_leaf_penalties(
    booster: PipelineModel, train: DataFrame, penalties: Sequence[float], label: str = "stars"
) -> list[PipelineModel]:
    """For each penalty, ``booster`` with leaf values under it; predictions keep their name.

    The trees are read once: the leaves of all rows are written, and every penalty is fitted on that table. ``booster`` is
    a pipeline that ends in its trees; it stays as it is.
    """
    *before, trees = booster.stages
    prediction = trees.getPredictionCol()
    leaf, names, flags = (f"{prediction}_{part}" for part in ("leaf", "leaf_names", "leaves"))
    grown = trees.copy().setLeafCol(leaf).setPredictionCol(f"{prediction}_unpenalised")
    listed = LeafNames(inputCol=leaf, outputCol=names)
    vocabulary = leaf_names(trees)
    marked = CountVectorizerModel.from_vocabulary(vocabulary, inputCol=names, outputCol=flags)
    encode = PipelineModel(stages=[*before, grown, listed, marked])
    rows = materialize(encode.transform(train).select(label, flags), "leaves")
    solver = "normal" if len(vocabulary) <= MOST_DIRECT else "l-bfgs"
    fitted = []
    for penalty in penalties:
        regression = ridge(rows, label, alpha=penalty, prediction=prediction, features=flags)
        fitted.append(PipelineModel(stages=[encode, regression.setSolver(solver).setTol(1e-10).fit(rows)]))
    return fitted


def fit_leaf_penalty(booster: PipelineModel, train: DataFrame, l2: float, label: str = "stars") -> PipelineModel:
    """``booster`` with leaf values under the penalty ``l2``."""
    return fit_leaf_penalties(booster, train, [l2], label)[0]
