"""Headers and column roles inferred from the shape of values, never from their words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import text

#: Rows below a candidate that must agree, rows that may be the header, and the least evidence for one.
ROWS_BELOW, CANDIDATES, LEAST_SCORE, LEAST_AGREEMENT = 5, 3, 0.50, 0.25
#: Roles in the order that breaks ties.
ROLES = ["identifier", "temporal", "measurement", "categorical", "parameter", "status"]


def typed(cells: DataFrame, column: str = "text") -> DataFrame:
    """Cells with their lexical type (kind), whether they are shaped like a code, and whether they read as a number (numeric)."""
    return text.with_types(cells, column).withColumnRenamed("number", "numeric").drop("score")


def _share(condition: Column, among: Column) -> Column:
    n = F.count(F.when(among, 1))
    return F.when(n > 0, F.count(F.when(among & condition, 1)) / n).otherwise(0.0)


def row_ratios(cells: DataFrame) -> DataFrame:
    """For each row of a table: filled, text, number and code ratio, label evidence and the types in column order."""
    filled = F.col("kind") != "empty"
    short = F.length(text.squash(F.col("text"))) <= 40
    label = 0.25 * _share(short, filled) + 0.25 * _share(~F.col("numeric"), filled) + 0.20 * _share(~F.col("code"), filled)
    ratios = typed(cells).groupBy("table_id", "row_index").agg(
        _share(filled, F.lit(True)).alias("filled_ratio"),
        _share(F.col("kind") == "text", filled).alias("text_ratio"),
        _share(F.col("kind") == "number", filled).alias("number_ratio"),
        _share(F.col("code"), filled).alias("code_ratio"),
        label.alias("label_evidence"),
        F.transform(F.array_sort(F.collect_list(F.struct("column_index", "kind"))), lambda x: x["kind"]).alias("types"),
    )
    return ratios


def column_agreement(cells: DataFrame) -> DataFrame:
    """For each of the first rows of a table how far the next rows agree on the type of each column.

    A column counts if it has two values below; full agreement counts 1, a mix of
    text and codes one half. Rows are taken in their order, whatever their numbers.
    """
    # only the first rows of a table matter: a row number under a limit is cut down before the shuffle, however long the table
    numbered = cells.select("table_id", "row_index").distinct().withColumn("place", F.row_number().over(Window.partitionBy("table_id").orderBy("row_index")))
    near = typed(cells.join(numbered.where(F.col("place") <= CANDIDATES + ROWS_BELOW), ["table_id", "row_index"]))
    # a row lies below each candidate up to five places above it: at most CANDIDATES copies of a row
    below = near.where(F.col("kind") != "empty").withColumn(
        "candidate", F.explode(F.filter(F.sequence(F.lit(1), F.lit(CANDIDATES)), lambda c: (F.col("place") > c) & (F.col("place") <= c + ROWS_BELOW)))
    )
    kinds = below.groupBy("table_id", "candidate", "column_index").agg(F.collect_set("kind").alias("kinds"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    mixed = F.size(F.array_except("kinds", F.array(F.lit("text"), F.lit("identifier_like")))) == 0
    agreement = F.avg(F.when(F.size("kinds") == 1, 1.0).when(mixed, 0.5).when(F.col("kinds").isNotNull(), 0.0))
    # only columns that the candidate row has itself
    own = near.where(F.col("place") <= CANDIDATES).select("table_id", F.col("place").alias("candidate"), "column_index", "row_index")
    joined = own.join(kinds, ["table_id", "candidate", "column_index"], "left")
    return joined.groupBy("table_id", "candidate", "row_index").agg(F.coalesce(agreement, F.lit(0.0)).alias("agreement"))


def header_scores(cells: DataFrame) -> DataFrame:
    """The score of each of a table's first rows as its header."""
    scored = column_agreement(cells).join(row_ratios(cells), ["table_id", "row_index"])
    plain = 0.20 * F.col("filled_ratio") + 0.20 * F.col("label_evidence") + 0.40 * F.col("agreement") + 0.15 * F.col("text_ratio") + 0.05 * (1 - F.col("code_ratio"))
    score = F.round(F.when(F.col("number_ratio") >= 0.5, plain * 0.55).otherwise(plain), 4)
    return scored.select("table_id", "row_index", "candidate", score.alias("score"), F.round("agreement", 4).alias("agreement"), F.round("label_evidence", 4).alias("label_evidence"))


def detect_headers(cells: DataFrame) -> DataFrame:
    """(table_id, header_row, score, detected): the best of the first rows, the earliest on a tie; null row without evidence."""
    best = header_scores(cells).groupBy("table_id").agg(F.max(F.struct("score", (-F.col("candidate")).alias("early"), "row_index", "agreement")).alias("b"))
    enough = (F.col("b.score") >= LEAST_SCORE) & (F.col("b.agreement") >= LEAST_AGREEMENT)
    return best.select("table_id", F.when(enough, F.col("b.row_index")).alias("header_row"), F.col("b.score").alias("score"), enough.alias("detected"))


def split_tables(cells: DataFrame) -> DataFrame:
    """Cells with their row's type: ``header`` for the detected header row, else ``data``."""
    headers = detect_headers(cells).select("table_id", "header_row")
    kind = F.when(F.col("row_index") == F.col("header_row"), "header").otherwise("data")
    return cells.join(headers, "table_id").withColumn("row_type", kind)


def column_profiles(cells: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """Counts, type ratios, role scores and primary role of each column.

    Values are grouped by column and value first, so a column of any size is
    summed from its distinct values. Empty values don't count.
    """
    values = cells.select(*by, text.squash(F.col(column)).alias("text")).where(F.col("text") != "")
    spelled = values.groupBy(*by, "text").agg(F.count(F.lit(1)).alias("n"))
    spelled = typed(spelled).drop("numeric").withColumns({"key": text.fold(F.col("text")), "short": F.length("text") <= 40})
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    keyed = spelled.groupBy(*by, "key").agg(
        F.sum("n").alias("n"),
        *(total(F.col("kind") == k).alias(k) for k in ("number", "date", "boolean", "text", "identifier_like")),
        total(F.col("code")).alias("code"),
        total(F.col("short")).alias("short"),
    )
    sums = keyed.groupBy(*by).agg(
        F.sum("n").alias("values"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"),
        *(F.sum(k).alias(k) for k in ("number", "date", "boolean", "text", "code", "short")),
    )
    n = F.col("values")
    ratios = {f"{k}_ratio": F.col(k) / n for k in ("number", "date", "boolean", "text", "code", "short", "repeated")} | {"unique_ratio": F.col("distinct_values") / n}
    return with_roles(sums.select(*by, "values", "distinct_values", *(c.alias(k) for k, c in ratios.items())))


def role_formulas() -> dict[str, Column]:
    """The score of each role from a column's ratios."""
    r = lambda name: F.col(f"{name}_ratio")
    categorical = 0.60 * r("text") + 0.30 * r("repeated") + 0.10 * (1 - r("code"))
    parameter = 0.55 * r("text") + 0.25 * r("short") + 0.20 * (1 - r("code"))
    parameter = parameter * F.when(r("number") >= 0.75, 0.20).otherwise(1.0) * F.when(r("date") >= 0.75, 0.20).otherwise(1.0)
    return {
        "identifier": 0.70 * r("code") + 0.30 * r("unique"),
        "temporal": 0.85 * r("date") + 0.10 * r("unique") + 0.05 * r("text"),
        "measurement": 0.85 * r("number") + 0.10 * r("unique") + 0.05 * (1 - r("boolean")),
        "categorical": categorical,
        "parameter": parameter,
        "status": 0.70 * r("boolean") + 0.30 * categorical,
    }


def with_roles(profiles: DataFrame) -> DataFrame:
    scored = profiles.withColumns({f"{k}_score": F.round(F.least(F.lit(1.0), c), 4) for k, c in role_formulas().items()})
    best = F.greatest(*(F.col(f"{k}_score") for k in ROLES))
    primary = reduce(lambda w, k: w.when(F.col(f"{k}_score") == best, k), ROLES[1:], F.when(F.col(f"{ROLES[0]}_score") == best, ROLES[0]))
    return scored.withColumn("primary_role", primary)


#: A value is strong evidence of what its record is from this score of its column on.
STRONG_SCORE = 0.80


def record_identifiers(fields: DataFrame, profiles: DataFrame) -> DataFrame:
    """(record_id, header, value): the values that identify a record, by the label of their header; of two under one header the last column counts."""
    strong = identifier_fields(fields, profiles, STRONG_SCORE).select("record_id", text.label(F.col("header")).alias("header"), text.fold(F.col("value")).alias("value"), "column_index")
    return strong.where("header <> ''").groupBy("record_id", "header").agg(F.max_by("value", F.struct("column_index", "value")).alias("value"))


def identifier_fields(fields: DataFrame, profiles: DataFrame, least: float = 0.60) -> DataFrame:
    """The fields of records that lie in columns with enough of the identifier role."""
    roles = profiles.where(F.col("identifier_score") >= least).select("table_id", "column_index", F.col("identifier_score").alias("score"))
    return fields.where(text.squash(F.col("value")) != "").join(roles, ["table_id", "column_index"])
