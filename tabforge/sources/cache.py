"""Prepared training data, computed once per dataset, strategy and parameters."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tabforge.functions.hashing import fingerprint
from tabforge.operators.profile import feature_stats
from tabforge.operators.split import train_test_split
from tabforge.operators.strategies import PreprocessorModel, create_strategy
from tabforge.sources import files
from tabforge.spec import SEED, TEST_SIZE, FeatureSpec

_PARTS = ("data", "preprocessor/state", "metadata")


@dataclass
class Prepared:
    rows: DataFrame
    preprocessor: PreprocessorModel
    metadata: dict

    def side(self, name: str) -> DataFrame:
        return self.rows.where(f"split = '{name}'").drop("split")


class PreparedCache:
    """Folders below ``root``, any Hadoop file system; metadata is written last and marks the end."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, mark: str, strategy: str, test_size: float, seed: int, spec: FeatureSpec, options: dict) -> str:
        """Rows, strategy and split are readable; column roles and options are in the last part."""
        roles = json.dumps([asdict(spec), options], sort_keys=True)
        return f"{self.root}/{mark}-{strategy}-{test_size}-{seed}-{hashlib.md5(roles.encode()).hexdigest()[:12]}"

    def complete(self, path: str) -> bool:
        return all(files.is_complete(self.spark, f"{path}/{part}") for part in _PARTS)

    def load(self, path: str) -> Prepared:
        return Prepared(
            files.read_split(self.spark, f"{path}/data"),
            PreprocessorModel.load(f"{path}/preprocessor"),
            files.read_document(self.spark, f"{path}/metadata"),
        )

    def get_or_create(
        self,
        df: DataFrame,
        spec: FeatureSpec,
        strategy: str,
        test_size: float = TEST_SIZE,
        seed: int = SEED,
        **options,
    ) -> Prepared:
        """The stored result for exactly these rows and parameters, computed when absent."""
        rows = df.select(spec.key, *spec.columns)
        mark = fingerprint(rows).first()["fingerprint"]
        path = self.path(mark, strategy, test_size, seed, spec, options)
        if not self.complete(path):
            self._create(rows, spec, strategy, test_size, seed, mark, path, options)
        return self.load(path)

    def _create(self, rows, spec, strategy, test_size, seed, mark, path, options) -> None:
        parted = train_test_split(rows, spec.key, test_size, seed)
        estimator = create_strategy(strategy, spec, **options)
        train = parted.where("split = 'train'")
        fitted = estimator.fit(train)
        files.write_split(fitted.transform(parted), f"{path}/data")
        fitted.save(f"{path}/preprocessor")
        counts = {r["split"]: r["count"] for r in files.read_split(self.spark, f"{path}/data").groupBy("split").count().collect()}
        stats = {
            r["feature"]: {k: r[k] for k in ("min", "max", "mean", "std")}
            for r in feature_stats(train, spec.features).collect()
        }
        metadata = {
            "preprocessing_version": estimator.version,
            "preprocessing_name": strategy,
            "preprocessing_description": estimator.description,
            "created_at": datetime.now(timezone.utc).isoformat(),
            "fingerprint": mark,
            "test_size": test_size,
            "random_state": seed,
            "options": options,
            "train_samples": counts.get("train", 0),
            "test_samples": counts.get("test", 0),
            "feature_columns": list(spec.features),
            "target_column": spec.target,
            "feature_stats": stats,
        }
        files.write_document(self.spark, metadata, f"{path}/metadata")

    def status(self) -> DataFrame:
        """Stored entries and whether they are complete."""
        rows = [(p.rsplit("/", 1)[-1], self.complete(p)) for p in files.children(self.spark, self.root)]
        return self.spark.createDataFrame(rows, "entry string, complete boolean")

    def clear(self, strategy: str | None = None) -> int:
        """Drops all entries, or those of one strategy; returns how many."""
        chosen = [
            p for p in files.children(self.spark, self.root)
            if strategy is None or f"-{strategy}-" in p.rsplit("/", 1)[-1]
        ]
        return sum(files.remove(self.spark, p) for p in chosen)
