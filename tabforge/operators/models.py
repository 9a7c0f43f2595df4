"""The four regressors as Spark ML estimators, their importances and their registry.

The defaults of the learners and the keys they are written under are fixed values.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators import trees
from tabforge.operators.parallel import in_parallel
from tabforge.spec import SEED, FeatureSpec

_VECTOR = "__features"
#: How the cuts' gains become the features' shares.
_IMPORTANCE = {"random_forest": "tree", "gradient_boost": "sum", "xgboost": "mean"}
_REGISTRY: dict[str, type[Regressor]] = {}


class RegressorModel(Model):
    """Fitted regressor: adds ``prediction`` to rows holding the features."""

    def __init__(self, name: str, spec: FeatureSpec, params: dict, inner):
        super().__init__()
        self.name, self.spec, self.hyperparameters, self.inner = name, spec, params, inner

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if isinstance(self.inner, trees.TreeModel):
            return dataset.withColumn("prediction", self.inner.prediction())
        return self.inner.transform(dataset).drop(_VECTOR)

    def importance(self) -> list[tuple[str, float]]:
        """Share of each feature, largest first."""
        if isinstance(self.inner, trees.TreeModel):
            values = self.inner.importance(_IMPORTANCE[self.name])
        else:
            sizes = [abs(c) for c in self.inner.stages[-1].coefficients.toArray()]
            values = [s / sum(sizes) if sum(sizes) else 0.0 for s in sizes]
        pairs = zip(self.spec.features, map(float, values), strict=True)
        return sorted(pairs, key=lambda pair: -pair[1])

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        body = {"name": self.name, "spec": asdict(self.spec), "params": self.hyperparameters}
        if isinstance(self.inner, trees.TreeModel):
            body["kind"] = "trees"
            self.inner.save(f"{path}/inner")
        else:
            self.inner.write().overwrite().save(f"{path}/inner")
        text = spark.createDataFrame([(json.dumps(body),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, path: str) -> RegressorModel:
        body = json.loads(SparkSession.active().read.text(f"{path}/state").first()["value"])
        spec = body["spec"]
        spec = FeatureSpec(spec["key"], tuple(spec["features"]), tuple(spec["categorical"]), spec["target"])
        kind = trees.TreeModel if body.get("kind") == "trees" else PipelineModel
        inner = kind.load(f"{path}/inner")
        return cls(body["name"], spec, body["params"], inner)


class Regressor(Estimator):
    """Defaults merged with overrides; ``transform`` exists only on what ``fit`` returns."""

    name = ""
    defaults: dict = {}

    def __init__(self, spec: FeatureSpec, **overrides):
        super().__init__()
        self.spec = spec
        self.hyperparameters = {**self.defaults, **overrides}

    def transform(self, dataset: DataFrame) -> DataFrame:
        raise RuntimeError("Model must be trained before prediction")

    def _assembled(self, dataset: DataFrame) -> tuple[VectorAssembler, DataFrame]:
        assembler = VectorAssembler(inputCols=list(self.spec.features), outputCol=_VECTOR)
        return assembler, assembler.transform(dataset).select(_VECTOR, self.spec.target)

    def _fit_learner(self, dataset: DataFrame, learner) -> RegressorModel:
        assembler, rows = self._assembled(dataset)
        inner = PipelineModel([assembler, learner.fit(rows)])
        return RegressorModel(self.name, self.spec, self.hyperparameters, inner)

    def _columns(self) -> dict:
        return {"featuresCol": _VECTOR, "labelCol": self.spec.target, "predictionCol": "prediction"}

    def fit_each(self, datasets: Sequence[DataFrame]) -> list[RegressorModel]:
        """A model for every dataset."""
        return in_parallel(datasets[0].sparkSession, self.fit, datasets)


class TreeRegressor(Regressor):
    """Learners on binned bytes: several datasets are trained in the same passes."""

    def rules(self) -> trees.Rules:
        raise NotImplementedError

    def _train(self, table: trees.Binned) -> list[trees.TreeModel]:
        return trees.boosted(table, self.hyperparameters["n_estimators"], self.rules())

    def layout(self, dataset: DataFrame) -> trees.Binned:
        """The written training table; learners with the same ``max_bins`` can share it."""
        spec = self.spec
        return trees.binned(dataset, spec.key, spec.features, spec.target, self.hyperparameters.get("max_bins", 256))

    def fit_layout(self, table: trees.Binned) -> list[RegressorModel]:
        return [RegressorModel(self.name, self.spec, self.hyperparameters, inner) for inner in self._train(table)]

    def _fit(self, dataset: DataFrame) -> RegressorModel:
        return self.fit_layout(self.layout(dataset))[0]

    def fit_each(self, datasets: Sequence[DataFrame]) -> list[RegressorModel]:
        layouts = in_parallel(datasets[0].sparkSession, self.layout, datasets)
        return self.fit_layout(trees.together(layouts))


def register(cls: type[Regressor]) -> type[Regressor]:
    _REGISTRY[cls.name] = cls
    return cls


def get_model(name: str) -> type[Regressor]:
    if name not in _REGISTRY:
        raise ValueError(f"Unknown model type '{name}'. Available: {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name]


def create_model(name: str, spec: FeatureSpec, **overrides) -> Regressor:
    return get_model(name)(spec, **overrides)


def list_models() -> list[str]:
    return sorted(_REGISTRY)


@register
class RidgeModel(Regressor):
    """Least squares with an L2 penalty on the slopes and a free intercept."""

    name = "linear"
    defaults = {"alpha": 1.0, "random_state": SEED}

    def _fit(self, dataset: DataFrame) -> RegressorModel:
        y = F.col(self.spec.target)
        n, spread = dataset.agg(F.count(y), F.stddev_pop(y)).first()
        # Spark divides the loss by n and works on labels of unit variance.
        penalty = self.hyperparameters["alpha"] * (spread or 1.0) / n
        learner = LinearRegression(
            solver="normal", elasticNetParam=0.0, standardization=False, regParam=penalty, **self._columns()
        )
        return self._fit_learner(dataset, learner)


@register
class ForestModel(TreeRegressor):
    """Bagged trees over all features; ``bootstrap=False`` gives every tree all rows."""

    name = "random_forest"
    defaults = {
        "n_estimators": 150,
        "max_depth": 15,
        "min_samples_split": 6,
        "min_samples_leaf": 3,
        "random_state": SEED,
    }

    def rules(self) -> trees.Rules:
        params = self.hyperparameters
        return trees.Rules(
            depth=params["max_depth"],
            split_rows=params["min_samples_split"],
            leaf_rows=params["min_samples_leaf"],
            sampling="bag" if params.get("bootstrap", True) else "all",
            seed=params["random_state"],
        )

    def _train(self, table: trees.Binned) -> list[trees.TreeModel]:
        return trees.forest(table, self.hyperparameters["n_estimators"], self.rules())


@register
class BoostedModel(TreeRegressor):
    """The mean, then trees fitted one after the other to what is left of the error, all of them shrunk."""

    name = "gradient_boost"
    defaults = {
        "n_estimators": 150,
        "max_depth": 5,
        "learning_rate": 0.1,
        "min_samples_split": 6,
        "min_samples_leaf": 3,
        "subsample": 0.8,
        "random_state": SEED,
    }

    def rules(self) -> trees.Rules:
        params = self.hyperparameters
        return trees.Rules(
            depth=params["max_depth"],
            split_rows=params["min_samples_split"],
            leaf_rows=params["min_samples_leaf"],
            shrink=params["learning_rate"],
            sampling="share",
            share=params["subsample"],
            seed=params["random_state"],
        )


@register
class RegularisedBoostedModel(TreeRegressor):
    """Boosted trees with penalised leaves and sampled rows and columns."""

    name = "xgboost"
    defaults = {
        "n_estimators": 150,
        "max_depth": 6,
        "learning_rate": 0.1,
        "subsample": 0.8,
        "colsample_bytree": 0.8,
        "reg_alpha": 0.1,
        "reg_lambda": 1.0,
        "max_bins": 256,
        "random_state": SEED,
    }

    def rules(self) -> trees.Rules:
        params = self.hyperparameters
        return trees.Rules(
            depth=params["max_depth"],
            l1=params["reg_alpha"],
            l2=params["reg_lambda"],
            least_gain=1e-6,
            shrink=params["learning_rate"],
            sampling="share",
            share=params["subsample"],
            seed=params["random_state"],
        )

    def _train(self, table: trees.Binned) -> list[trees.TreeModel]:
        params = self.hyperparameters
        return trees.boosted(table, params["n_estimators"], self.rules(), params["colsample_bytree"])


def fit_all(
    spec: FeatureSpec, wanted: Sequence[tuple[str, dict]], datasets: Sequence[DataFrame]
) -> list[list[RegressorModel]]:
    """For every (model, parameters) a model for every dataset.

    A dataset is laid out once for all tree learners of the same bins. Learners that differ in the number of
    trees alone are trained once, with the most: the first trees are those that fewer would have given.
    """
    learners = [create_model(name, spec, **params) for name, params in wanted]
    layouts: dict[int, trees.Binned] = {}
    trained: dict[str, list[RegressorModel]] = {}
    found = []
    for learner in learners:
        if not isinstance(learner, TreeRegressor):
            found.append(learner.fit_each(datasets))
            continue
        rest = {k: v for k, v in learner.hyperparameters.items() if k != "n_estimators"}
        same = [x for x in learners if x.name == learner.name and {**x.hyperparameters, **rest} == x.hyperparameters]
        most = max(same, key=lambda x: x.hyperparameters["n_estimators"])
        key = json.dumps([most.name, most.hyperparameters], sort_keys=True, default=str)
        if key not in trained:
            bins = learner.hyperparameters.get("max_bins", 256)
            if bins not in layouts:
                layouts[bins] = trees.together(in_parallel(datasets[0].sparkSession, learner.layout, datasets))
            trained[key] = most.fit_layout(layouts[bins])
        n = learner.hyperparameters["n_estimators"]
        found.append(
            [RegressorModel(m.name, spec, learner.hyperparameters, m.inner.first(n)) for m in trained[key]]
        )
    return found


def importance_table(spark: SparkSession, model: RegressorModel, top: int | None = None) -> DataFrame:
    """Features by rank, at most ``top`` of them."""
    rows = [(f, v, i + 1) for i, (f, v) in enumerate(model.importance()) if top is None or i < top]
    return spark.createDataFrame(rows, "feature string, importance double, rank int")
