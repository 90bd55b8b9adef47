"""Upkeep of the index and its ledger: merge with history, upserts, insert-if-absent, state differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.statuses import CURRENT, HISTORICAL


def merge_index(previous: DataFrame, current: DataFrame, owner: str = "document_id") -> DataFrame:
    """The current index and what the previous one has of owners that are gone, marked by source status.

    Nothing is deleted when a source goes missing; an owner that returns replaces
    all its old rows. Merging again with the same current side changes nothing.
    """
    owners = current.select(owner).distinct()
    kept = previous.join(owners, owner, "left_anti").withColumn("source_status", F.lit(HISTORICAL))
    return kept.unionByName(current.withColumn("source_status", F.lit(CURRENT)), allowMissingColumns=True)


def state_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): added, removed, modified or unchanged by the hash of the content."""
    a, b = before.select(key, F.col(content).alias("x")), after.select(key, F.col(content).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it lacks; nulls count as equal."""
    condition = None
    known = base.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        condition = same if condition is None else condition & same
    return base.unionByName(new.join(known, condition, "left_anti"))


def latest_wins(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``: an upsert by partial maxima."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("s")).select("s.*")


def ledger_union(*ledgers: DataFrame) -> DataFrame:
    """All entries of several ledgers, identical ones once."""
    out = ledgers[0]
    for ledger in ledgers[1:]:
        out = out.unionByName(ledger)
    return out.distinct()


def publish_complete(pages: DataFrame, owner: str, failed: Column) -> DataFrame:
    """The pages of owners none of whose pages failed: all of a document or nothing."""
    bad = pages.where(failed).select(owner).distinct()
    return pages.join(bad, owner, "left_anti")


def stale(outputs: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Outputs whose owner is no longer active, to be listed and not deleted here."""
    return outputs.join(active.select(key).distinct(), key, "left_anti")
