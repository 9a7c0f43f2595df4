"""A trained pipeline as one folder: model, preprocessor, statistics, signature, metadata."""

from __future__ import annotations

import json
import platform
import uuid
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators.models import RegressorModel
from tabforge.operators.scoring import range_warnings, respond
from tabforge.operators.strategies import PreprocessorModel
from tabforge.sources import files

_METRICS = T.MapType(T.StringType(), T.DoubleType())
METADATA_SCHEMA = T.StructType(
    [
        T.StructField("artifact_id", T.StringType(), False),
        T.StructField("created_at", T.StringType(), False),
        T.StructField("model_type", T.StringType(), False),
        T.StructField("model_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("preprocessing_strategy", T.StringType(), False),
        T.StructField("preprocessing_version", T.StringType(), False),
        T.StructField("feature_names", T.ArrayType(T.StringType()), False),
        T.StructField("target_name", T.StringType()),
        T.StructField("training_samples", T.LongType()),
        T.StructField("test_samples", T.LongType()),
        T.StructField("random_state", T.LongType()),
        T.StructField(
            "feature_stats",
            T.MapType(
                T.StringType(),
                T.StructType([T.StructField("min", T.DoubleType()), T.StructField("max", T.DoubleType())]),
            ),
        ),
        T.StructField("train_metrics", _METRICS),
        T.StructField("test_metrics", _METRICS),
        T.StructField("cv_metrics", _METRICS),
        T.StructField("feature_importance", _METRICS),
        T.StructField("run_id", T.StringType()),
        T.StructField("experiment_name", T.StringType()),
        T.StructField("artifact_version", T.StringType()),
        T.StructField("framework_versions", T.MapType(T.StringType(), T.StringType())),
        T.StructField("signature", T.StringType()),
    ]
)


class Bundle:
    def __init__(self, model: RegressorModel, preprocessor: PreprocessorModel, metadata: dict):
        self.model, self.preprocessor, self.metadata = model, preprocessor, metadata

    @classmethod
    def create(
        cls,
        model: RegressorModel,
        preprocessor: PreprocessorModel,
        training_samples: int,
        test_samples: int = 0,
        ranges: dict[str, tuple[float, float]] | None = None,
        train_metrics: dict | None = None,
        test_metrics: dict | None = None,
        cv_metrics: dict | None = None,
        run_id: str | None = None,
        experiment_name: str | None = None,
    ) -> Bundle:
        """Assembles the metadata. ``ranges`` are those of the raw training rows, as requests are raw."""
        spec = model.spec
        signature = T.StructType([T.StructField(f, T.DoubleType()) for f in spec.features])
        metadata = {
            "artifact_id": str(uuid.uuid4()),
            "created_at": datetime.now(timezone.utc).isoformat(),
            "model_type": model.name,
            "model_params": {k: str(v) for k, v in model.hyperparameters.items()},
            "preprocessing_strategy": preprocessor.name,
            "preprocessing_version": preprocessor.version,
            "feature_names": list(spec.features),
            "target_name": spec.target,
            "training_samples": training_samples,
            "test_samples": test_samples,
            "random_state": int(model.hyperparameters.get("random_state", 0)),
            "feature_stats": {f: {"min": lo, "max": hi} for f, (lo, hi) in (ranges or {}).items()},
            "train_metrics": train_metrics or {},
            "test_metrics": test_metrics or {},
            "cv_metrics": cv_metrics or {},
            "feature_importance": dict(model.importance()),
            "run_id": run_id,
            "experiment_name": experiment_name,
            "artifact_version": "1.0.0",
            "framework_versions": {"pyspark": pyspark.__version__, "python": platform.python_version()},
            "signature": signature.json(),
        }
        return cls(model, preprocessor, metadata)

    def save(self, path: str) -> str:
        spark = SparkSession.active()
        self.model.save(f"{path}/model")
        self.preprocessor.save(f"{path}/preprocessor")
        body = dict(self.metadata)
        body["feature_stats"] = {f: Row(**s) for f, s in body["feature_stats"].items()}
        row = Row(**{f.name: body[f.name] for f in METADATA_SCHEMA.fields})
        spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
        return path

    @classmethod
    def load(cls, path: str) -> Bundle:
        spark = SparkSession.active()
        for part in ("metadata", "model", "preprocessor"):
            files.require(spark, f"{path}/{part}", f"Bundle {part}")
        row = spark.read.schema(METADATA_SCHEMA).json(f"{path}/metadata").first()
        return cls(
            RegressorModel.load(f"{path}/model"),
            PreprocessorModel.load(f"{path}/preprocessor"),
            row.asDict(recursive=True),
        )

    def check_signature(self, df: DataFrame) -> None:
        """Raises when a feature is absent or not a number."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        for field in T.StructType.fromJson(json.loads(self.metadata["signature"])).fields:
            if field.name not in kinds:
                raise ValueError(f"Missing columns: ['{field.name}']")
            if not isinstance(kinds[field.name], T.NumericType):
                raise ValueError(f"{field.name} is {kinds[field.name].simpleString()}, not a number")

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` and ``warnings``; the features keep the values they came with."""
        self.check_signature(df)
        spec = self.model.spec
        ranges = {f: (s["min"], s["max"]) for f, s in self.metadata["feature_stats"].items()}
        raw = df.withColumn("warnings", range_warnings(spec.features, ranges)).withColumn(
            "__raw", F.struct(*spec.features)
        )
        scored = self.model.transform(self.preprocessor.transform(raw))
        return scored.withColumns({f: F.col(f"__raw.{f}") for f in spec.features}).drop("__raw")

    def respond(self, df: DataFrame) -> DataFrame:
        return respond(self.predict(df), self.metadata["artifact_id"], self.metadata["model_type"])

    def info(self, source: str | None = None) -> dict:
        """Metadata for display: empty maps and zero counts become None."""
        shown = (
            "model_type", "preprocessing_strategy", "preprocessing_version", "feature_names",
            "training_samples", "train_metrics", "test_metrics", "artifact_id", "created_at",
        )
        info = {k: self.metadata[k] for k in shown}
        info["test_samples"] = self.metadata["test_samples"] or None
        info["feature_importance"] = self.metadata["feature_importance"] or None
        return {**info, "run_id": self.metadata["run_id"], "prediction_source": source}


def load_first(paths: list[str]) -> tuple[Bundle | None, str | None]:
    """The first bundle that loads: registry first, then the local copy, else nothing."""
    for path in paths:
        try:
            return Bundle.load(path), path
        except Exception:  # noqa: BLE001 - a broken source means: try the next one
            continue
    return None, None
