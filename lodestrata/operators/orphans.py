"""References to records that do not exist, and what hangs below them.

A *reference* names a key of another table. It is a direct orphan when that key
is absent, withdrawn, or published only after the referring row. Rows that refer
to an orphaned row are orphans by inheritance; they are found by semi-joining
down the foreign-key graph until a round adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.skew import skew_lookup
from lodestrata.session import materialize

MISSING, DELETED, LATE = "missing", "deleted", "late"


@dataclass(frozen=True)
class Target:
    """A table that is referred to: its key, when a key's row was published, when withdrawn."""

    name: str
    rows: DataFrame
    key: str
    published: str
    withdrawn: str


@dataclass(frozen=True)
class Reference:
    """References of one field: ``rows`` gives the referring row's key, the key referred to and the time."""

    table: str
    field: str
    rows: DataFrame
    key: Column
    target_key: Column
    time: Column
    target: str


@dataclass(frozen=True)
class Edge:
    """Rows of ``child`` (key ``key``) that hang below rows of ``parent`` by ``parent_key``."""

    child: str
    field: str
    rows: DataFrame
    key: Column
    parent_key: Column
    time: Column
    parent: str


def key_states(targets: list[Target]) -> DataFrame:
    """One row per table and key: first publication and whether the latest state is withdrawn.

    Null keys are left out. Where two rows of a key share the latest publication
    time, a withdrawn one counts as the later.
    """

    def one(t: Target) -> DataFrame:
        state = F.struct(F.col(t.published).alias("at"), F.col(t.withdrawn).alias("gone"))
        return (
            t.rows.where(F.col(t.key).isNotNull())
            .groupBy(F.lit(t.name).alias("target_table"), F.col(t.key).cast("string").alias("target_key"))
            .agg(F.min(t.published).alias("first_published"), F.max(state)["gone"].isNotNull().alias("withdrawn"))
        )

    return reduce(DataFrame.unionByName, map(one, targets))


def references(refs: list[Reference]) -> DataFrame:
    """All non-null references in one shape. A row is kept once however often it was delivered."""

    def one(r: Reference) -> DataFrame:
        return r.rows.select(
            F.lit(r.table).alias("ref_table"),
            F.lit(r.field).alias("ref_field"),
            r.key.cast("string").alias("ref_key"),
            F.lit(r.target).alias("target_table"),
            r.target_key.cast("string").alias("target_key"),
            r.time.alias("ref_time"),
        ).where(F.col("target_key").isNotNull())

    return reduce(DataFrame.unionByName, map(one, refs))


def direct_orphans(refs: list[Reference], targets: list[Target]) -> DataFrame:
    """Direct orphans (ref_table, ref_field, ref_key, target_table, target_key, ref_month, reason), distinct.

    ``reason`` is ``missing``, else ``deleted``, else ``late``. A reference without
    a time has a null month and can't be late; a key whose publication time is
    unknown can't make one late either.
    """
    joined = skew_lookup(references(refs), key_states(targets).withColumn("known", F.lit(True)), ["target_table", "target_key"])
    reason = (
        F.when(F.col("known").isNull(), MISSING)
        .when(F.col("withdrawn"), DELETED)
        .when(F.col("first_published") > F.col("ref_time"), LATE)
    )
    return (
        joined.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("ref_table", "ref_field", "ref_key", "target_table", "target_key", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "reason")
        .distinct()
    )


def orphan_cascade(refs: list[Reference], targets: list[Target], edges: list[Edge]) -> DataFrame:
    """Direct orphans and everything that inherits from them.

    Columns of ``direct_orphans`` plus ``kind`` (``direct``/``inherited``) and
    ``depth`` (0 for direct). Each round semi-joins the rows below the rows that
    were new in the last one; rows already reached are left out, so cycles and
    self references end. A row that is an orphan itself is not reported as
    inherited. Empty tables give an empty result.
    """
    direct = materialize(direct_orphans(refs, targets), "orphans")
    rounds = [direct.withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})]
    reached = direct.select(F.col("ref_table").alias("table"), F.col("ref_key").alias("key")).distinct()
    frontier, depth = reached, 0
    while edges:
        depth += 1
        below = reduce(DataFrame.unionByName, (_below(e, frontier) for e in edges))
        fresh = below.join(reached.withColumnsRenamed({"table": "ref_table", "key": "ref_key"}), ["ref_table", "ref_key"], "left_anti")
        fresh = materialize(fresh.distinct(), f"orphans-{depth}")
        if fresh.isEmpty():
            break
        rounds.append(fresh.withColumns({"reason": F.lit("inherited"), "kind": F.lit("inherited"), "depth": F.lit(depth)}))
        frontier = fresh.select(F.col("ref_table").alias("table"), F.col("ref_key").alias("key")).distinct()
        reached = reached.unionByName(frontier)
    return reduce(DataFrame.unionByName, rounds)


def _below(edge: Edge, frontier: DataFrame) -> DataFrame:
    rows = edge.rows.select(
        F.lit(edge.child).alias("ref_table"),
        F.lit(edge.field).alias("ref_field"),
        edge.key.cast("string").alias("ref_key"),
        F.lit(edge.parent).alias("target_table"),
        edge.parent_key.cast("string").alias("target_key"),
        F.date_format(edge.time, "yyyy-MM").alias("ref_month"),
    )
    gone = frontier.where(F.col("table") == edge.parent).select(F.col("key").alias("target_key")).distinct()
    return skew_lookup(rows, gone, ["target_key"], "left_semi").select(rows.columns)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month: direct ones by reason and inherited ones."""
    count = lambda c: F.count(F.when(c, 1))
    return orphans.groupBy("ref_table", "ref_field", "ref_month").agg(
        *(count(F.col("reason") == r).alias(f"n_{r}") for r in (MISSING, DELETED, LATE)),
        count(F.col("kind") == "direct").alias("n_direct"),
        count(F.col("kind") == "inherited").alias("n_inherited"),
        F.countDistinct("ref_key").alias("n_rows"),
    )
