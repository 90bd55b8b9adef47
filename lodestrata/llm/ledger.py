"""Entries of the decision ledger: the table and the raw JSON lines in one shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import table

TEXTS = ["document", "page", "original_text", "source_text", "verified_text", "human_decision", "decision", "evidence_type", "timestamp_utc"]
_PAYLOAD = ", ".join(f"{c} STRING" for c in TEXTS) + ", recovered_from_historical_log BOOLEAN"


def instant(text: Column) -> Column:
    """Microseconds of an ISO 8601 time; without an offset it is UTC. Null where blank or unreadable."""
    trimmed = F.trim(text)
    zoned = F.when(trimmed.rlike(r"(Z|z|[+-]\d\d:?\d\d)$"), trimmed).otherwise(F.concat(trimmed, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """decision_id, the texts of TEXTS, recovered (null counts as no) and at (microseconds)."""
    reviewed = table(spark, folder, "manual_review_decisions").select("decision_id", *(F.col(c).cast("string") for c in TEXTS), "recovered_from_historical_log")
    lines = table(spark, folder, "ledger_lines").select("decision_id", F.from_json("payload", _PAYLOAD).alias("p")).select("decision_id", "p.*")
    both = reviewed.unionByName(lines)
    return both.withColumn("recovered", F.coalesce("recovered_from_historical_log", F.lit(False))).withColumn("at", instant(F.col("timestamp_utc"))).drop("recovered_from_historical_log")
