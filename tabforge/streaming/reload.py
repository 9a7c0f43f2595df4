"""Swapping models between micro-batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tabforge.spec import ALIASES


@dataclass
class ModelSlots:
    """Loaded models by alias. ``load(path)`` makes a model; ``aliases()`` says where they lie.

    An alias that moved is loaded again before the next micro-batch. When that
    fails the old model stays and the failure is kept for the load counter.
    """

    aliases: Callable[[], DataFrame]
    load: Callable[[str], object]
    models: dict[str, object] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    loads: list[tuple[str, str, str]] = field(default_factory=list)

    def refresh(self, only: str | None = None) -> None:
        wanted = {r["alias"]: r["path"] for r in self.aliases().where(_alias_filter()).collect()}
        for alias, path in wanted.items():
            if (only and alias != only) or self.paths.get(alias) == path:
                continue
            try:
                self.models[alias] = self.load(path)
                self.paths[alias] = path
                self.loads.append((alias, path, "success"))
            except Exception:  # noqa: BLE001 - serving goes on with what is loaded
                self.loads.append((alias, path, "failure"))

    def at(self, paths: dict[str, str]) -> dict[str, object]:
        """The models at given paths, whatever the aliases name now."""
        return {a: self.models[a] if self.paths.get(a) == path else self.load(path) for a, path in paths.items()}

    def score_batches(self, score: Callable[[DataFrame, dict], DataFrame], path: str):
        """Function for ``foreachBatch``: refresh, score, write this batch's own folder."""

        def run(batch: DataFrame, epoch: int) -> None:
            self.refresh()
            score(batch, self.models).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

        return run


def _alias_filter() -> str:
    return "alias IN (" + ", ".join(f"'{a}'" for a in ALIASES) + ")"
