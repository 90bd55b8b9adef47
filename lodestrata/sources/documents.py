"""Documents of scanned pages as nested records: readers, layouts of several versions, listings and catalogs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import text
from lodestrata.operators import geometry
from lodestrata.session import ship

CELL = "struct<row:int,column:int,text:string,confidence:double,status:string,bbox:array<double>>"
TABLE = f"struct<status:string,source:string,rows:array<struct<row:int,cells:array<{CELL}>>>>"
BLOCK = "struct<text:string,confidence:double,bbox:array<double>>"
PAGE = f"struct<document:string,page:int,image:string,blocks:array<{BLOCK}>,tables:array<{TABLE}>,reconstructed_tables:array<{TABLE}>>"
#: A stage's document; older ones hold their pages inside ``documents``.
DOCUMENT = f"document string, document_id string, source_pdf string, page_count int, pages array<{PAGE}>, documents array<struct<document:string,pages:array<{PAGE}>>>"
# Fixed value: the status of a cell that only a fallback read.
FALLBACK = "FALLBACK_OCR"
# Layouts of the table file of a page, in the order they are tried.
TABLE_LAYOUTS = ["{document}/{page}/tables.json", "{document}/{page}_tables.json", "{page}/tables.json"]


def read_documents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON documents of one folder with the stated schema. ``strict`` fails on an unreadable one, else it is left out."""
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    if strict:
        return reader.option("mode", "FAILFAST").schema(DOCUMENT).json(path)
    return reader.option("mode", "DROPMALFORMED").schema(DOCUMENT).json(path)


def list_files(spark: SparkSession, path: str, glob: str = "*", exclude_prefix: str | None = None) -> DataFrame:
    """(path, name, modified, length) of the files of a folder, without those whose name starts with the prefix; contents stay unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), "length")
    return named if exclude_prefix is None else named.where(~F.col("name").startswith(exclude_prefix))


def newest(files: DataFrame, by: Column) -> DataFrame:
    """The newest file of each ``by``, the greater path on a tie."""
    return files.groupBy(by.alias("owner")).agg(F.max_by("path", F.struct("modified", "path")).alias("path"))


def first_layout(candidates: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """Of several layouts of the same thing the first that exists."""
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(priority)).alias("s")).select(*keys, "s.*")


def pages_of(documents: DataFrame) -> DataFrame:
    """(document, ordinal, page): the pages of current and of older documents; those of a document without any are an error to the caller."""
    pages = F.coalesce("pages", F.element_at("documents", 1)["pages"])
    name = F.coalesce(F.nullif("document", F.lit("")), "document_id", F.element_at("documents", 1)["document"])
    return documents.select(name.alias("document"), F.posexplode(pages).alias("ordinal", "page"))


def require_pages(documents: DataFrame) -> DataFrame:
    """The same documents; one without pages fails the job when it is read."""
    size = F.coalesce(F.size(F.coalesce("pages", F.element_at("documents", 1)["pages"])), F.lit(0))
    checked = F.when(size > 0, F.col("document")).otherwise(F.raise_error(F.concat(F.lit("no pages in document "), F.coalesce("document", F.lit("?")))))
    return documents.withColumn("document", checked)


def adapt_tables(documents: DataFrame) -> DataFrame:
    """Cells of a stage's documents as comparable tables: the first row is the header, places are numbered from 1.

    Reconstructed tables count if a page has any, else its raw ones. A cell that
    only a fallback read is UNVERIFIED; text, box and confidence stay as they are.
    """
    p = F.col("page")
    some = F.coalesce(F.size(p["reconstructed_tables"]), F.lit(0)) > 0
    tables = pages_of(documents).select("document", p["page"].alias("page"), F.posexplode(F.when(some, p["reconstructed_tables"]).otherwise(p["tables"])).alias("t", "table"))
    rows = tables.select("document", "page", (F.col("t") + 1).alias("table_index"), F.posexplode("table.rows").alias("r", "row"))
    cells = rows.select("document", "page", "table_index", (F.col("r") + 1).alias("row_index"), F.posexplode("row.cells").alias("c", "cell")).where("cell IS NOT NULL")
    flat = cells.select(
        "document", "page", "table_index", "row_index", F.coalesce("cell.column", F.col("c") + 1).alias("column_index"), F.col("cell.text").alias("value"),
        F.when(F.col("cell.status") == FALLBACK, "UNVERIFIED").otherwise(F.col("cell.status")).alias("verification_status"),
        F.col("cell.confidence").alias("source_ocr_confidence"), "cell.bbox",
    )
    place = ["document", "page", "table_index", "column_index"]
    header = flat.where("row_index = 1").groupBy(*place).agg(F.min("value").alias("header"))
    table_id = F.concat_ws(":", "document", F.concat(F.lit("p"), "page"), F.concat(F.lit("t"), "table_index"))
    return flat.where("row_index > 1").join(header, place, "left").withColumn("table_id", table_id)


def geometry_tables(blocks: DataFrame, page: list[str], least_columns: int = 3) -> DataFrame:
    """Blocks placed on a grid where their page has rows of ``least_columns`` or more: (page…, key, row_number, column_number, text)."""
    placed = geometry.grid_of_blocks(blocks, page, "block_id").join(blocks.select("block_id", "text"), "block_id")
    wide = placed.groupBy(*page, "row_number").agg(F.countDistinct("column_number").alias("n")).where(F.col("n") >= least_columns).select(*page).distinct()
    return placed.join(wide, page, "left_semi")


def coalesced(aliases: list[str], nested: Column | None = None) -> Column:
    """The first non-empty of a field's names over the versions, then of a nested container."""
    own = [F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in aliases]
    return F.coalesce(*own, *([nested] if nested is not None else []))


def page_image(document: Column, page: Column) -> Column:
    """Where the image of a page lies, by the naming pattern."""
    return F.concat(document, F.lit("/"), F.format_string("page_%04d", page.cast("int")), F.lit(".png"))


def recovered(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """An inline relation of recovered decisions (document, page, original, source, verified, decision)."""
    return spark.createDataFrame(rows, "document STRING, page STRING, original_text STRING, source_text STRING, verified_text STRING, decision STRING")


def job_catalog(runs: DataFrame) -> DataFrame:
    """The last known state of each job from its runs (job_id, stage, status, at)."""
    return runs.groupBy("job_id").agg(F.max_by(F.struct("stage", "status"), F.struct("at", "stage")).alias("s"), F.min("at").alias("created_at"), F.max("at").alias("updated_at")).select(
        "job_id", "s.stage", "s.status", "created_at", "updated_at"
    )


def with_engine(images: DataFrame, engine: Callable[[bytes], list[tuple[str, float, list[list[float]]]]]) -> DataFrame:
    """Blocks that an external text engine finds on page images (path, content): the boundary to such engines.

    ``engine`` takes the bytes of an image and gives text, confidence and polygon of
    each block. A page that it fails on has one row without a block and with the
    error, so it does not look empty; ``error`` is null elsewhere.
    """
    ship(images.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.extend([(path, i, t, round(float(c), 4), p, None) for i, (t, c, p) in enumerate(engine(content))])
                except Exception as error:
                    rows.append((path, None, None, None, None, f"{type(error).__name__}: {error}"))
            frame = pd.DataFrame(rows, columns=["path", "block_index", "text", "confidence", "polygon", "error"])
            yield frame.astype({"block_index": "Int32", "confidence": "float64"})

    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("block_index", T.IntegerType()), T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()), T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("error", T.StringType()),
    ])
    found = images.select("path", "content").mapInPandas(run, schema)
    return found.withColumn("bbox", geometry.polygon_box(F.col("polygon"))).drop("polygon").withColumn("text", F.when(F.col("text").isNotNull(), text.squash(F.col("text"))))
