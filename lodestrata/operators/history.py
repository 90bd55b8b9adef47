"""What each run of a stage changed, by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.merge import state_diff


def run_changes(before: DataFrame, after: DataFrame, stage: int, status: str) -> DataFrame:
    """(stage, status, path, change) of one run; a failed run is recorded like any other."""
    changes = state_diff(before, after, "path", "sha256")
    return changes.select(F.lit(stage).alias("stage"), F.lit(status).alias("status"), "path", "change")


def versions(states: DataFrame) -> DataFrame:
    """(path, n_versions, n_runs) over the states (run, path, sha256) of all runs."""
    return states.groupBy("path").agg(F.countDistinct("sha256").alias("n_versions"), F.countDistinct("run").alias("n_runs"))
