"""Keyed comparison of tables: rows meet by their key or not at all, values are never rounded."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import statuses, text
from lodestrata.functions.udfs import similarity
from lodestrata.session import materialize

#: Statuses of rows and cells, all of them listed in a summary.
STATUSES = ["CHANGED", "UNCHANGED", "ADDED", "REMOVED", "AMBIGUOUS"]
#: Tables match from this header similarity on; two candidates closer than the gap are ambiguous.
LEAST_SIMILARITY, LEAST_GAP = 0.5, 0.05


def flatten_side(cells: DataFrame, key: Column, row: Column) -> DataFrame:
    """(row_key, row_id, header, value, uncertain) from (header, value, verification_status) cells.

    Blank keys give unkeyed rows. Of two cells under one header the one with the
    greater column number counts.
    """
    rows = cells.select(
        F.nullif(text.fold(key), F.lit("")).alias("row_key"), row.cast("string").alias("row_id"), text.label(F.col("header")).alias("header"), "column_index", "value",
        statuses.is_uncertain(F.col("verification_status")).alias("uncertain"),
    )
    last = F.max_by(F.struct("value", "uncertain"), F.struct("column_index", "value", "uncertain"))
    return rows.groupBy("row_key", "row_id", "header").agg(last.alias("c")).select("row_key", "row_id", "header", "c.value", "c.uncertain")


def _unique_rows(side: DataFrame) -> DataFrame:
    """Keyed cells of each key's last row, with a mark where several rows share the key."""
    rows = side.where("row_key IS NOT NULL").groupBy("row_key").agg(F.max("row_id").alias("row_id"), (F.countDistinct("row_id") > 1).alias("repeated"))
    return side.join(rows, ["row_key", "row_id"])


def diff_cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Status and value relation of every (row_key, header) of two flattened sides.

    Headers are those of either side; the two verdicts are independent. A row that
    is on one side only has its cells ADDED or REMOVED.
    """
    a = _unique_rows(left).select("row_key", "header", F.col("value").alias("left_value"), F.col("uncertain").alias("lu"), F.lit(True).alias("on_left"), F.col("repeated").alias("lr"))
    b = _unique_rows(right).select("row_key", "header", F.col("value").alias("right_value"), F.col("uncertain").alias("ru"), F.lit(True).alias("on_right"), F.col("repeated").alias("rr"))
    both = a.join(b, ["row_key", "header"], "full_outer")
    empty_left, empty_right = text.fold(F.col("left_value")) == "", text.fold(F.col("right_value")) == ""
    same = text.fold(F.col("left_value")) == text.fold(F.col("right_value"))
    relation = F.when(empty_left, F.when(empty_right, "MISSING").otherwise("RIGHT_ONLY")).when(empty_right, "LEFT_ONLY").when(same, "MATCH").otherwise("DIFFERENT")
    uncertain = F.coalesce("lu", F.lit(False)) | F.coalesce("ru", F.lit(False))
    status = F.when(F.col("on_left").isNull(), "ADDED").when(F.col("on_right").isNull(), "REMOVED").when(uncertain, "AMBIGUOUS").when(same, "UNCHANGED").otherwise("CHANGED")
    repeated = F.coalesce("lr", F.lit(False)) | F.coalesce("rr", F.lit(False))
    return both.select("row_key", "header", "left_value", "right_value", status.alias("status"), relation.alias("value_relation"), repeated.alias("repeated_key"), "on_left", "on_right")


def diff_rows(cells: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(row_key, row_id, status) of every row; unkeyed rows are ADDED or REMOVED by themselves."""
    keyed = cells.groupBy("row_key").agg(
        F.max("on_left").alias("l"), F.max("on_right").alias("r"), F.max("repeated_key").alias("repeated"),
        F.max(F.col("status") == "AMBIGUOUS").alias("ambiguous"), F.max(F.col("status").isin("CHANGED", "ADDED", "REMOVED")).alias("changed"),
    )
    status = (
        F.when(F.col("l").isNull(), "ADDED").when(F.col("r").isNull(), "REMOVED").when(F.col("repeated") | F.col("ambiguous"), "AMBIGUOUS").when(F.col("changed"), "CHANGED").otherwise("UNCHANGED")
    )
    alone = lambda side, s: side.where("row_key IS NULL").select("row_key", "row_id").distinct().withColumn("status", F.lit(s))
    return keyed.select("row_key", F.lit(None).cast("string").alias("row_id"), status.alias("status")).unionByName(alone(left, "REMOVED")).unionByName(alone(right, "ADDED"))


def summary(rows: DataFrame, column: str = "status") -> DataFrame:
    """Number of rows of every status, 0 where there are none."""
    found = rows.groupBy(F.col(column).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "status STRING")
    return every.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def header_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(header, place): whether a header is on both sides or on one."""
    a, b = left.select("header").distinct().withColumn("l", F.lit(1)), right.select("header").distinct().withColumn("r", F.lit(1))
    place = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, "header", "full_outer").select("header", place.alias("place"))


def table_similarity(left: DataFrame, right: DataFrame, within: list[str]) -> DataFrame:
    """Header similarity of the tables that share ``within`` and a header: .75 of the Jaccard share, .25 of the sequence ratio.

    Sides are (within…, table_id, header). Pairs come from shared headers; a pair
    that shares none can't reach LEAST_SIMILARITY (the ratio counts a quarter).
    """
    heads = lambda side, t: side.where("header <> ''").groupBy(*within, F.col("table_id").alias(t)).agg(F.array_sort(F.collect_set("header")).alias(f"{t}_headers"))
    a, b = heads(left, "left_table"), heads(right, "right_table")
    shared = a.withColumn("header", F.explode("left_table_headers")).join(b.withColumn("header", F.explode("right_table_headers")), [*within, "header"])
    pairs = shared.groupBy(*within, "left_table", "right_table").agg(F.first("left_table_headers").alias("x"), F.first("right_table_headers").alias("y"))
    jaccard = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    joined = pairs.withColumns({"jaccard": jaccard, "a": F.array_join("x", " | "), "b": F.array_join("y", " | ")})
    spelled = joined.select("a", "b").distinct().withColumn("ratio", similarity("a", "b"))
    return joined.join(spelled, ["a", "b"]).select(*within, "left_table", "right_table", (0.75 * F.col("jaccard") + 0.25 * F.col("ratio")).alias("score"))


def match_tables(scores: DataFrame, within: list[str]) -> DataFrame:
    """(within…, left_table, right_table, status): tables matched one to one in the order of the left side.

    Greedy by nature, so each group of ``within`` (a document) is one task; its
    input is the scored pairs of the document's tables.
    """

    def greedy(pairs: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for table, own in pairs.sort_values(["left_table", "score", "right_table"], ascending=[True, False, True]).groupby("left_table", sort=True):
            free = own[~own["right_table"].isin(used)]
            if free.empty or free["score"].iloc[0] < LEAST_SIMILARITY:
                out.append((table, None, "REMOVED"))
            elif len(free) > 1 and free["score"].iloc[0] - free["score"].iloc[1] < LEAST_GAP:
                out.append((table, None, "AMBIGUOUS"))
            else:
                used.add(free["right_table"].iloc[0])
                out.append((table, free["right_table"].iloc[0], "MATCHED"))
        found = pd.DataFrame(out, columns=["left_table", "right_table", "status"])
        for c in within:
            found[c] = pairs[c].iloc[0]
        return found

    kinds = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in within)
    return scores.groupBy(*within).applyInPandas(greedy, f"left_table STRING, right_table STRING, status STRING, {kinds}")


def match_all_tables(left: DataFrame, right: DataFrame, within: list[str]) -> DataFrame:
    """``match_tables`` for every table of both sides, also those without a shared header.

    Sides as for ``table_similarity``. A left table without a candidate is REMOVED, a
    right table that none was matched with is ADDED.
    """
    matched = materialize(match_tables(table_similarity(left, right, within), within), "matched")

    def unmatched(side: DataFrame, name: str) -> DataFrame:
        known = matched.where(F.col(name).isNotNull()).select(*(F.col(c).alias(f"_{c}") for c in within), F.col(name).alias("_table"))
        condition = F.col(name) == F.col("_table")
        for c in within:
            condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return side.select(*within, F.col("table_id").alias(name)).where(F.col(name).isNotNull()).distinct().join(known, condition, "left_anti")

    none = F.lit(None).cast("string")
    removed = unmatched(left, "left_table").withColumns({"right_table": none, "status": F.lit("REMOVED")})
    added = unmatched(right, "right_table").withColumns({"left_table": none, "status": F.lit("ADDED")})
    return matched.unionByName(removed).unionByName(added)
