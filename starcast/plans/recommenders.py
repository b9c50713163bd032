"""The feature-based recommenders, from source tables to predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcast.functions.numeric import clip, ensemble_mean
from starcast.models.linear import assembler, fit_linear, mean_imputer
from starcast.models.stacking import fit_stacked
from starcast.models.trees import fit_on_vectors, gbt_a, gbt_b
from starcast.operators.coldstart import append_predictions, cold_start_prediction
from starcast.operators.features import (
    TOP_CATEGORIES,
    assemble_pair_features,
    attach_with_defaults,
    business_features,
    category_labels,
    feature_names,
    fill_mean,
    fill_values,
    linear_business_view,
    linear_user_view,
    missing_flags,
    user_features,
)
from starcast.operators.friends import mutual_friend_mean, popular_friends
from starcast.operators.ids import mark_cold, prune_entities
from starcast.operators.ratings import global_mean, latest_rating
from starcast.operators.skew import HeavyKeys, heavy_in_pairs
from starcast.session import materialize, materialize_measured, materialize_training, row_count

DEPTH_A_STACKED, TREES_B_STACKED = 6, 700


@dataclass(frozen=True)
class Heavy:
    """Heavy keys of one table of pairs, counted once for all its joins."""

    users: HeavyKeys
    businesses: HeavyKeys
    pairs: HeavyKeys


def count_heavy(pairs: DataFrame, total: int) -> Heavy:
    return Heavy(*heavy_in_pairs(pairs, ["user_id", "business_id"], total))


@dataclass(frozen=True)
class PairFeatures:
    """Written feature tables of training ratings and of pairs to score, and the pairs left to the cold-start rule. A job
    that only trains does without the last two: they are written when they are first asked for."""

    made: Prepared
    train: DataFrame
    names: list[str]
    mean_stars: float

    @property
    def labels(self) -> list[str]:
        return self.made.labels

    @property
    def users(self) -> DataFrame:
        return self.made.users

    @property
    def businesses(self) -> DataFrame:
        return self.made.businesses

    @cached_property
    def known(self) -> DataFrame:
        return materialize(self.made.known_features(), "pair-features")

    @cached_property
    def cold(self) -> DataFrame:
        heavy = self.made.heavy_pairs
        marked = mark_cold(self.made.pairs, self.users, self.businesses, heavy.users, heavy.businesses)
        return materialize(marked.where("is_cold").drop("is_cold"), "cold-pairs")

    def with_cold(self, known: DataFrame) -> DataFrame:
        """Predictions for known pairs, then those of the cold-start rule."""
        cold = cold_start_prediction(self.cold, self.users, self.businesses, self.mean_stars)
        return append_predictions(known, cold)


@dataclass(frozen=True)
class Prepared:
    """The written inputs of the tree models, with what their joins need to know. Heavy keys are counted for the tables
    whose joins are asked for."""

    ratings: DataFrame
    pairs: DataFrame
    users: DataFrame
    businesses: DataFrame
    labels: list[str]
    latest: DataFrame
    n_ratings: int
    n_pairs: int
    popular: HeavyKeys
    on_unknown: str

    @cached_property
    def heavy_ratings(self) -> Heavy:
        return count_heavy(self.ratings, self.n_ratings)

    @cached_property
    def heavy_pairs(self) -> Heavy:
        return count_heavy(self.pairs, self.n_pairs)

    def features(self, rows: DataFrame, heavy: Heavy, carry: Sequence[str] = ()) -> DataFrame:
        """``rows`` of users and businesses, those with both entity rows, with the features of the tree models, and the
        fields ``carry`` of the businesses."""
        friends = mutual_friend_mean(rows, self.users, self.latest, heavy.users, heavy.businesses, self.popular)
        return assemble_pair_features(
            rows,
            user_features(self.users),
            business_features(self.businesses, self.labels, self.on_unknown, carry),
            friends,
            False,
            heavy.users,
            heavy.businesses,
            heavy.pairs,
        )

    def train_features(self) -> DataFrame:
        rows = self.ratings.select("user_id", "business_id", F.col("stars").cast("double").alias("stars"))
        return self.features(rows, self.heavy_ratings)

    def known_features(self, carry: Sequence[str] = ()) -> DataFrame:
        return self.features(self.pairs, self.heavy_pairs, carry)


def prepare(
    ratings: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    pairs: DataFrame,
    order_cols: Sequence[str] = (),
    categories: int = TOP_CATEGORIES,
    on_unknown: str = "error",
    labels: Sequence[str] | None = None,
) -> Prepared:
    """``labels``: the category labels to flag; by default the most frequent ones are found."""
    ratings, of_ratings = materialize_measured(
        ratings.select("user_id", "business_id", "stars", *order_cols), "train", total=row_count()
    )
    pairs, of_pairs = materialize_measured(pairs.select("user_id", "business_id"), "pairs", total=row_count())
    users = materialize(prune_entities(users, ratings, pairs, "user_id"), "users")
    businesses = materialize(prune_entities(businesses, ratings, pairs, "business_id"), "businesses")

    return Prepared(
        ratings=ratings,
        pairs=pairs,
        users=users,
        businesses=businesses,
        labels=category_labels(businesses, categories) if labels is None else list(labels),
        latest=materialize(latest_rating(ratings, order_cols), "latest"),
        n_ratings=of_ratings["total"],
        n_pairs=of_pairs["total"],
        popular=popular_friends(users),
        on_unknown=on_unknown,
    )


def pair_features(
    ratings: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    pairs: DataFrame,
    order_cols: Sequence[str] = (),
    categories: int = TOP_CATEGORIES,
    columns: Sequence[str] | None = None,
    on_unknown: str = "error",
) -> PairFeatures:
    """Everything the tree models train on and score.

    ``columns`` are the features to learn from, by default all. A noise label that is not known raises, or counts as
    missing with ``on_unknown='null'``.
    """
    made = prepare(ratings, users, businesses, pairs, order_cols, categories, on_unknown)
    train = materialize_training(made.train_features(), "train-features")
    return PairFeatures(made, train, chosen_features(train, columns), global_mean(made.ratings).first()[0])


def chosen_features(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """All feature columns, or those of ``columns``, which must exist."""
    names = feature_names(df)
    if columns is None:
        return names
    if unknown := sorted(set(columns) - set(names)):
        raise ValueError(f"no such features: {', '.join(unknown)}")
    return [name for name in names if name in columns]


def missing_columns(features: DataFrame, names: Sequence[str]) -> list[str]:
    """The feature columns that lack a value in some row."""
    lacking = features.agg(*[F.expr(f"max(`{c}` is null or isnan(`{c}`)) as `{c}`") for c in names]).first()
    return [c for c in names if lacking[c]]


@dataclass(frozen=True)
class TreeInput:
    """Rows without missing values, which the tree learner cannot take, and the columns to learn from.

    A missing value becomes 0; each column of ``flagged`` has a 0/1 column that says where. Flags that never vary in
    training are not learnt from, and only pairs to score have them.
    """

    features: PairFeatures
    in_train: list[str]

    @property
    def names(self) -> list[str]:
        return [*self.features.names, *[f"{c}_missing" for c in self.in_train]]

    @property
    def train(self) -> DataFrame:
        return missing_flags(self.features.train, self.in_train)

    @cached_property
    def flagged(self) -> list[str]:
        in_known = missing_columns(self.features.known, self.features.names)
        return [c for c in self.features.names if c in self.in_train or c in in_known]

    @property
    def known(self) -> DataFrame:
        return missing_flags(self.features.known, self.flagged)


def tree_input(features: PairFeatures) -> TreeInput:
    return TreeInput(features, missing_columns(features.train, features.names))


def linear_recommender(
    ratings: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    pairs: DataFrame,
    categories: int = TOP_CATEGORIES,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Least squares on the linear views, or on ``columns`` of them; a user or business without a row gets the default
    row. Not clipped."""
    ratings, of_ratings = materialize_measured(
        ratings.select("user_id", "business_id", "stars"), "train", total=row_count()
    )
    pairs, of_pairs = materialize_measured(pairs.select("user_id", "business_id"), "pairs", total=row_count())
    users = linear_user_view(prune_entities(users, ratings, pairs, "user_id"))
    pruned = materialize(prune_entities(businesses, ratings, pairs, "business_id"), "businesses")
    labels = category_labels(pruned, categories)
    businesses = linear_business_view(pruned, labels)

    in_train, in_pairs = count_heavy(ratings, of_ratings["total"]), count_heavy(pairs, of_pairs["total"])
    train = materialize(
        attach_with_defaults(ratings, users, businesses, labels, in_train.users, in_train.businesses), "linear-train"
    )
    scored = attach_with_defaults(pairs, users, businesses, labels, in_pairs.users, in_pairs.businesses)
    imputer = mean_imputer(train, chosen_features(train, columns))
    model = fit_linear(imputer.transform(train), imputer.columns)
    return model.transform(imputer.transform(scored)).select("user_id", "business_id", "prediction")


def training_vectors(inputs: TreeInput) -> DataFrame:
    """A written table of the training rows as vectors."""
    wide = assembler(inputs.names).transform(inputs.train)
    return materialize_training(wide.select("user_id", "business_id", "stars", "features"), "train-vectors")


def fit_boosters(
    inputs: TreeInput, vectors: DataFrame, params_a: Mapping | None = None, params_b: Mapping | None = None
) -> tuple[PipelineModel, PipelineModel]:
    """The two boosters; their predictions are named ``prediction_a`` and ``prediction_b``."""
    a = fit_on_vectors(vectors, inputs.names, gbt_a(prediction="prediction_a", **(params_a or {})))
    b = fit_on_vectors(vectors, inputs.names, gbt_b(prediction="prediction_b", **(params_b or {})))
    return a, b


def error_per_tree(model: PipelineModel, vectors: DataFrame) -> list[float]:
    """The RMSE of a booster with its first tree, its first two trees, and so on."""
    trees = model.stages[-1]
    # The fitted model reads the new name of its column once it has scored rows or was saved, and the old one before.
    rows = vectors.withColumn(trees.getFeaturesCol(), F.col("features"))
    return [error**0.5 for error in trees.evaluateEachIteration(rows, "squared")]


def hybrid_recommender(
    ratings: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    pairs: DataFrame,
    order_cols: Sequence[str] = (),
    params_a: Mapping | None = None,
    params_b: Mapping | None = None,
    columns: Sequence[str] | None = None,
    on_unknown: str = "error",
) -> DataFrame:
    """The clipped mean of two boosters for known pairs, and the cold-start rule for the rest."""
    features = pair_features(
        ratings, users, businesses, pairs, order_cols, columns=columns, on_unknown=on_unknown
    )
    inputs = tree_input(features)
    a, b = fit_boosters(inputs, training_vectors(inputs), params_a, params_b)
    scored = b.transform(a.transform(inputs.known))
    mixed = clip(ensemble_mean(F.col("prediction_a"), F.col("prediction_b")))
    return features.with_cold(scored.select("user_id", "business_id", mixed.alias("prediction")))


def stacked_recommender(
    ratings: DataFrame,
    users: DataFrame,
    businesses: DataFrame,
    pairs: DataFrame,
    order_cols: Sequence[str] = (),
    params_a: Mapping | None = None,
    params_b: Mapping | None = None,
    params_meta: Mapping | None = None,
    stats_from: str = "train",
    out_of_fold: bool = False,
    columns: Sequence[str] | None = None,
    on_unknown: str = "error",
) -> DataFrame:
    """The clipped mean of two boosters and a stacked model for known pairs, and the cold-start rule for the rest.

    The stacked model works on mean-filled columns. With ``stats_from='self'`` the means that fill the pairs to score
    come from those pairs, with ``'train'`` from the training rows.
    """
    if stats_from not in ("train", "self"):
        raise ValueError("stats_from must be 'train' or 'self'")
    features = pair_features(
        ratings, users, businesses, pairs, order_cols, columns=columns, on_unknown=on_unknown
    )
    inputs = tree_input(features)
    a, b = fit_boosters(
        inputs,
        training_vectors(inputs),
        {"maxDepth": DEPTH_A_STACKED, **(params_a or {})},
        {"maxIter": TREES_B_STACKED, "minInstancesPerNode": 1, **(params_b or {})},
    )
    values = fill_values(features.train, features.names)
    filled = fill_mean(features.train, values)
    meta = gbt_b(
        prediction="prediction_stacked", **{"maxIter": TREES_B_STACKED, "minInstancesPerNode": 1, **(params_meta or {})}
    )
    stacked = fit_stacked(filled, features.names, meta, out_of_fold=out_of_fold)

    own = values if stats_from == "train" else fill_values(features.known, features.names)
    boosted = b.transform(a.transform(inputs.known))
    # The boosters read zeros where the stacked model reads means; the flags say where to put them.
    refilled = boosted.withColumns({
        c: F.when(F.col(f"{c}_missing") == 1, F.lit(own[c])).otherwise(F.col(c)) for c in inputs.flagged
    })
    scored = stacked.transform(refilled)
    mixed = clip(ensemble_mean(*[F.col(f"prediction_{name}") for name in ("a", "b", "stacked")]))
    return features.with_cold(scored.select("user_id", "business_id", mixed.alias("prediction")))
