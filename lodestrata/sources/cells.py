"""Cells and fields of tables in long form: one row per cell, its place carried as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import table

PLACE = ["document_id", "page", "table_id", "table_index", "source_row_index"]


def latest_records(records: DataFrame) -> DataFrame:
    """The latest state of each record; of states of one time the withdrawn one. Records without an id are left out."""
    rest = [c for c in records.columns if c != "record_id"]
    state = F.struct(*(F.col(c) for c in rest))
    order = F.struct("indexed_at", "removed_at")
    chosen = records.where("record_id IS NOT NULL").groupBy("record_id").agg(F.max_by(state, order).alias("s"))
    return chosen.select("record_id", "s.*")


def record_fields(records: DataFrame) -> DataFrame:
    """One row per non-null field of each record's latest state; the column number comes from the key ``column_N``."""
    entry = F.explode(F.map_entries("fields")).alias("e")
    rows = latest_records(records).select("record_id", "source_status", *PLACE, entry).where("e.value IS NOT NULL")
    number = F.regexp_extract("e.key", r"(\d+)$", 1).try_cast("int")
    return rows.select("record_id", "source_status", *PLACE, number.alias("column_index"), "e.value.header", "e.value.value", "e.value.normalized_value")


def fields_of(spark: SparkSession, folder: str) -> DataFrame:
    return record_fields(table(spark, folder, "records"))


def cells_with_header(fields: DataFrame) -> DataFrame:
    """(table_id, document_id, row_index, column_index, text): the table as it was scanned, its header as row 1.

    A column whose records disagree about the header takes the smallest; a column
    without any has an empty header cell.
    """
    data = fields.select("table_id", "document_id", F.col("source_row_index").alias("row_index"), "column_index", F.coalesce("value", F.lit("")).alias("text"))
    header = fields.groupBy("table_id", "document_id", "column_index").agg(F.coalesce(F.min("header"), F.lit("")).alias("text"))
    return header.select("table_id", "document_id", F.lit(1).alias("row_index"), "column_index", "text").unionByName(data)


def value_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The value index with each occurrence once: the row delivered last."""
    rows = table(spark, folder, "value_index")
    rest = [c for c in rows.columns if c != "occurrence_id"]
    last = rows.groupBy("occurrence_id").agg(F.max_by(F.struct(*rest), F.struct("loaded_at", "value")).alias("s"))
    return last.select("occurrence_id", "s.*")
