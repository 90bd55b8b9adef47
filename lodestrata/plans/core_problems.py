"""Queries of the general record problems: orphan references (p1) and nested records (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import dewey, orphans
from lodestrata.sources.tables import table

#: Where fields sit below an occurrence, whatever program version wrote it.
FIELD_PATH = r"\.fields(\[\]|\.[^.\[\]]*#)$"


def _orphan_graph(spark: SparkSession, folder: str):
    links = table(spark, folder, "entity_links")
    index = table(spark, folder, "entity_retrieval_index")
    cross = table(spark, folder, "cross_document_query_index")
    nested = index.select("entity_id", "built_at", F.explode("records.record_id").alias("record_id"))
    targets = [
        orphans.Target("entities", table(spark, folder, "entities"), "entity_id", "created_at", "retired_at"),
        orphans.Target("records", table(spark, folder, "records"), "record_id", "indexed_at", "removed_at"),
    ]
    refs = [
        orphans.Reference("entity_links", "entity_id", links, F.col("link_id"), F.col("entity_id"), F.col("linked_at"), "entities"),
        orphans.Reference("entity_links", "record_id", links, F.col("link_id"), F.col("record_id"), F.col("linked_at"), "records"),
        orphans.Reference("entity_retrieval_index", "record_id", nested, F.col("entity_id"), F.col("record_id"), F.col("built_at"), "records"),
    ]
    # an element of the index is built from a link of its entity to its record, the cross-document index from the index
    built = nested.join(links.select("entity_id", "record_id", "link_id").distinct(), ["entity_id", "record_id"])
    edges = [
        orphans.Edge("entity_retrieval_index", "link_id", built, F.col("entity_id"), F.col("link_id"), F.col("built_at"), "entity_links"),
        orphans.Edge("cross_document_query_index", "entity_id", cross, F.col("entity_id"), F.col("entity_id"), F.col("built_at"), "entity_retrieval_index"),
    ]
    return refs, targets, edges


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Direct orphans of the cascade."""
    found = orphans.orphan_cascade(*_orphan_graph(spark, folder))
    return found.where(F.col("kind") == "direct").select("ref_table", "ref_field", "ref_key", "target_key", "ref_month", "reason").distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    """Direct and inherited orphans per table, field and month."""
    return orphans.orphan_report(orphans.orphan_cascade(*_orphan_graph(spark, folder)))


def p1_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans by table and depth: direct ones at 0, what hangs below them from 1 on."""
    found = orphans.orphan_cascade(*_orphan_graph(spark, folder))
    return found.groupBy("ref_table", "ref_field", "depth", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ref_key").alias("n_rows"))


def _number(column) -> F.Column:
    return F.regexp_extract(column, r"(\d+)$", 1).try_cast("int")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Flat children of records, retrieval index and cross-document index."""
    records = dewey.shred(table(spark, folder, "records"), F.col("record_id"), "fields")["fields{}"]
    index = dewey.shred(table(spark, folder, "entity_retrieval_index"), F.col("entity_id"), "records")
    cross = dewey.shred_json(table(spark, folder, "cross_document_query_index"), F.col("entity_id"), F.col("occurrences"), rf"^\[\]$|{FIELD_PATH}", ["column_index", "field_key"])
    element, position = F.col("node").isNotNull(), F.split_part("dewey", F.lit("."), F.lit(1)).cast("int")
    zero, here = F.lit(0), F.col("ordinal")
    parts = [
        records.where(element).select(F.lit("records").alias("owner_table"), F.col("owner").alias("owner_key"), zero.alias("item_pos"), _number("name").alias("column_index")),
        index["records[]"].where(element).select(F.lit("entity_retrieval_index"), "owner", here, zero),
        index["records[].fields[]"].where(element).select(F.lit("entity_retrieval_index"), "owner", position, F.col("node.column_index")),
        cross.where(F.col("kind") != "null").select(
            F.lit("cross_document_query_index"), "owner", position,
            F.when(F.col("path") == "[]", zero).otherwise(F.coalesce(_number("name"), F.col("attributes")["column_index"].try_cast("int"), _number(F.col("attributes")["field_key"]))),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def p6_field_table(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of the retrieval index with their Dewey label and the label of the record they belong to."""
    fields = dewey.shred(table(spark, folder, "entity_retrieval_index"), F.col("entity_id"), "records")["records[].fields[]"]
    return fields.where(F.col("node").isNotNull()).select("owner", "dewey", "parent", "ordinal", "node.column_index", "node.header", "node.value").distinct()


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_cascade": p1_cascade, "p6_found": p6_found, "p6_field_table": p6_field_table}

_P1 = """
WITH target AS (
  SELECT 'entities' AS t, entity_id AS k, min(created_at) AS first_at,
         arg_max(retired_at IS NOT NULL, (coalesce(created_at, TIMESTAMP '0001-01-01'), retired_at IS NOT NULL)) AS gone
  FROM entities WHERE entity_id IS NOT NULL GROUP BY entity_id
  UNION ALL
  SELECT 'records', record_id, min(indexed_at),
         arg_max(removed_at IS NOT NULL, (coalesce(indexed_at, TIMESTAMP '0001-01-01'), removed_at IS NOT NULL))
  FROM records WHERE record_id IS NOT NULL GROUP BY record_id
), ref AS (
  SELECT 'entity_links' AS ref_table, 'entity_id' AS ref_field, CAST(link_id AS VARCHAR) AS ref_key, 'entities' AS t, entity_id AS k, linked_at AS at FROM entity_links
  UNION ALL SELECT 'entity_links', 'record_id', CAST(link_id AS VARCHAR), 'records', record_id, linked_at FROM entity_links
  UNION ALL SELECT 'entity_retrieval_index', 'record_id', entity_id, 'records', r.record_id, built_at
            FROM (SELECT entity_id, built_at, unnest(records) AS r FROM entity_retrieval_index)
), direct AS (
  SELECT DISTINCT ref_table, ref_field, ref_key, ref.k AS target_key, strftime(ref.at, '%Y-%m') AS ref_month,
         CASE WHEN target.k IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN first_at > ref.at THEN 'late' END AS reason
  FROM ref LEFT JOIN target ON target.t = ref.t AND target.k = ref.k WHERE ref.k IS NOT NULL
)
"""

_CASCADE = """, bad AS (SELECT ref_table, ref_field, ref_key, target_key, ref_month, reason FROM direct WHERE reason IS NOT NULL),
below_link AS (
  SELECT DISTINCT n.entity_id AS ref_key, CAST(l.link_id AS VARCHAR) AS target_key, strftime(n.built_at, '%Y-%m') AS ref_month
  FROM (SELECT entity_id, built_at, r.record_id AS record_id FROM (SELECT entity_id, built_at, unnest(records) AS r FROM entity_retrieval_index)) n
  JOIN entity_links l ON l.entity_id = n.entity_id AND l.record_id = n.record_id
  WHERE CAST(l.link_id AS VARCHAR) IN (SELECT ref_key FROM bad WHERE ref_table = 'entity_links')
    AND n.entity_id NOT IN (SELECT ref_key FROM bad WHERE ref_table = 'entity_retrieval_index' AND ref_key IS NOT NULL)
), below_index AS (SELECT DISTINCT entity_id AS ref_key, strftime(built_at, '%Y-%m') AS ref_month FROM cross_document_query_index WHERE entity_id IS NOT NULL),
every AS (
  SELECT ref_table, ref_field, ref_key, ref_month, reason, 'direct' AS kind, 0 AS depth FROM bad
  UNION ALL SELECT 'entity_retrieval_index', 'link_id', ref_key, ref_month, 'inherited', 'inherited', 1 FROM below_link
  UNION ALL SELECT 'cross_document_query_index', 'entity_id', ref_key, ref_month, 'inherited', 'inherited', 1 FROM below_index
            WHERE ref_key IN (SELECT ref_key FROM bad WHERE ref_table = 'entity_retrieval_index')
  UNION ALL SELECT 'cross_document_query_index', 'entity_id', ref_key, ref_month, 'inherited', 'inherited', 2 FROM below_index
            WHERE ref_key IN (SELECT ref_key FROM below_link) AND ref_key NOT IN (SELECT ref_key FROM bad WHERE ref_table = 'entity_retrieval_index' AND ref_key IS NOT NULL)
)
"""

SQL = {
    "p1_cascade": _P1 + _CASCADE + "SELECT ref_table, ref_field, depth, kind, count(*) AS n, count(DISTINCT ref_key) AS n_rows FROM every GROUP BY ALL",
    "p1_found": _P1 + "SELECT ref_table, ref_field, ref_key, target_key, ref_month, reason FROM direct WHERE reason IS NOT NULL",
    "p1_report": _P1
    + _CASCADE
    + """SELECT ref_table, ref_field, ref_month, count(*) FILTER (reason = 'missing') AS n_missing, count(*) FILTER (reason = 'deleted') AS n_deleted,
       count(*) FILTER (reason = 'late') AS n_late, count(*) FILTER (kind = 'direct') AS n_direct,
       count(*) FILTER (kind = 'inherited') AS n_inherited, count(DISTINCT ref_key) AS n_rows
FROM every GROUP BY ref_table, ref_field, ref_month""",
    "p6_found": """
WITH rec AS (SELECT record_id, unnest(map_entries(fields)) AS e FROM records),
eri AS (SELECT entity_id, unnest(records) AS r, unnest(range(len(records))) AS pos FROM entity_retrieval_index),
eri_field AS (SELECT entity_id, pos, unnest(r.fields) AS f FROM eri WHERE r IS NOT NULL),
raw AS (SELECT entity_id, CAST(occurrences AS JSON) AS j FROM cross_document_query_index WHERE occurrences IS NOT NULL),
whole AS (SELECT entity_id, CASE json_type(j) WHEN 'VARCHAR' THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM raw),
listed AS (SELECT entity_id, CASE json_type(j) WHEN 'OBJECT' THEN json_array(j) ELSE j END AS j FROM whole WHERE json_type(j) IN ('OBJECT', 'ARRAY')),
item AS (SELECT entity_id, unnest(CAST(j AS JSON[])) AS o, unnest(range(CAST(json_array_length(j) AS BIGINT))) AS pos FROM listed),
holder AS (SELECT entity_id, pos, coalesce(CASE WHEN json_type(o -> 'fields') <> 'NULL' THEN o -> 'fields' END, o -> 'record' -> 'fields') AS f
           FROM item WHERE o IS NOT NULL AND json_type(o) = 'OBJECT'),
keyed AS (SELECT entity_id, pos, f, unnest(json_keys(f)) AS k FROM holder WHERE json_type(f) = 'OBJECT'),
ranked AS (SELECT entity_id, pos, unnest(CAST(f AS JSON[])) AS e FROM holder WHERE json_type(f) = 'ARRAY')
SELECT DISTINCT owner_table, owner_key, CAST(item_pos AS INTEGER) AS item_pos, CAST(column_index AS INTEGER) AS column_index FROM (
  SELECT 'records' AS owner_table, record_id AS owner_key, 0 AS item_pos, CAST(regexp_extract(e.key, '([0-9]+)$', 1) AS INTEGER) AS column_index FROM rec WHERE e.value IS NOT NULL
  UNION ALL SELECT 'entity_retrieval_index', entity_id, pos, 0 FROM eri WHERE r IS NOT NULL
  UNION ALL SELECT 'entity_retrieval_index', entity_id, pos, f.column_index FROM eri_field WHERE f IS NOT NULL
  UNION ALL SELECT 'cross_document_query_index', entity_id, pos, 0 FROM item WHERE json_type(o) <> 'NULL'
  UNION ALL SELECT 'cross_document_query_index', entity_id, pos, CAST(regexp_extract(k, '([0-9]+)$', 1) AS INTEGER) FROM keyed
            WHERE json_type(json_extract(f, '$."' || k || '"')) <> 'NULL'
  UNION ALL SELECT 'cross_document_query_index', entity_id, pos,
            CAST(coalesce(e ->> 'column_index', regexp_extract(e ->> 'field_key', '([0-9]+)$', 1)) AS INTEGER) FROM ranked WHERE json_type(e) <> 'NULL'
)""",
    "p6_field_table": """
WITH eri AS (SELECT entity_id, unnest(records) AS r, unnest(range(len(records))) AS pos FROM entity_retrieval_index),
fld AS (SELECT entity_id, pos, unnest(r.fields) AS f, unnest(range(len(r.fields))) AS i FROM eri WHERE r IS NOT NULL)
SELECT DISTINCT entity_id AS owner, pos || '.' || i AS dewey, CAST(pos AS VARCHAR) AS parent, CAST(i AS INTEGER) AS ordinal,
       f.column_index AS column_index, f.header AS header, f.value AS value FROM fld WHERE f IS NOT NULL""",
}
