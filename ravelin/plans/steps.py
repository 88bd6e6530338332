"""An ordered list of DataFrame steps, with row-level error isolation and counts by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


class Pipeline:
    def __init__(self, *steps: tuple[str, Step]):
        self.steps = list(steps)
        self.counts: dict[str, Observation] = {}

    def add(self, name: str, step: Step, position: int | None = None) -> Pipeline:
        self.steps.insert(len(self.steps) if position is None else position, (name, step))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        """All steps as one lazy plan; rows that leave each step are counted while an action runs."""
        for name, step in self.steps:
            self.counts[name] = Observation()
            df = df.transform(step).observe(self.counts[name], F.count(F.lit(1)).alias("rows"))
        return df

    def rows(self) -> dict[str, int]:
        """Counts of the action that ran last."""
        return {name: o.get["rows"] for name, o in self.counts.items()}


def isolated(condition: Column, reason: str) -> Step:
    """Rows that meet condition keep their place and get a reason in _error; later steps may leave them out."""

    def step(df: DataFrame) -> DataFrame:
        old = F.col("_error") if "_error" in df.columns else F.lit(None).cast("string")
        return df.withColumn("_error", F.coalesce(old, F.when(condition, reason)))

    return step
