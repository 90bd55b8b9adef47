"""Text rules, structure inference, entities and index upkeep over the project tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.functions import udfs
from lodestrata.operators import entities, profile
from lodestrata.plans import sqltext as q
from lodestrata.session import materialize
from lodestrata.sources.cells import cells_with_header, fields_of, latest_records, value_cells
from lodestrata.sources.tables import table


def f1_text_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct values in their normal forms."""
    v = F.col("value")
    values = table(spark, folder, "value_index").where(v.isNotNull()).select("value").distinct()
    return values.select("value", text.squash(v).alias("squashed"), text.fold(v).alias("folded"), text.engine_text(v).alias("engine"))


def f8_value_types(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical types and code scores of all values."""
    values = table(spark, folder, "value_index").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return text.with_types(values, "value").groupBy("kind", "score").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))


def f9_candidate_looks(spark: SparkSession, folder: str) -> DataFrame:
    """the candidate and the verification dialect side by side."""
    v = F.col("value")
    values = table(spark, folder, "value_index").where(v.isNotNull()).select("value").distinct()
    return values.select("value", text.numeric_like(v).alias("is_numeric"), text.temporal_like(v).alias("is_temporal"), text.code_like(v).alias("is_code"), text.identifier_like(v).alias("is_identifier"))


def f12_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """number of standalone numbers and skeleton of each reviewed text."""
    o = F.col("original_text")
    texts = table(spark, folder, "manual_review_decisions").where(o.isNotNull()).select("decision_id", "original_text", "source_text")
    return texts.select("decision_id", F.size(text.numbers(o)).alias("n_numbers"), text.skeleton(o).alias("skeleton"), text.numbers_equal(o, F.col("source_text")).alias("same_numbers"))


def f13_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """technical and high-risk signs in values, with the values that hold them."""
    v = F.col("value")
    values = table(spark, folder, "value_index").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    signs = values.select(F.explode(text.technical_symbols(v)).alias("sign"), "n")
    return signs.groupBy("sign").agg(F.sum("n").alias("n_values"), F.max(F.col("sign").rlike(f"[{text.HIGH_RISK}]")).alias("high_risk"))


def f14_class_strings(spark: SparkSession, folder: str) -> DataFrame:
    """F14, F16, F17 (native part): values by the classes of their characters."""
    shapes = table(spark, folder, "value_index").where("value IS NOT NULL").groupBy(text.class_string(F.col("value")).alias("classes"))
    return shapes.agg(F.count(F.lit(1)).alias("n_values"))


def f15_special_characters(spark: SparkSession, folder: str) -> DataFrame:
    """special characters of the values with code point, name and category."""
    values = table(spark, folder, "value_index").where(F.col("value").rlike(r"[^A-Za-z0-9\s]")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    found = values.select(F.explode(udfs.special_characters("value")).alias("c"), "n")
    return found.groupBy("c.character", "c.code", "c.name", "c.category").agg(F.sum("n").alias("n_values"))


def f17_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of distinct values, with the number of values and of token patterns of each."""
    values = table(spark, folder, "value_index").where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    shaped = values.select(udfs.shape(udfs.nfc("value")).alias("shape"), F.array_join(udfs.tokens("value"), " ").alias("tokens"), "n")
    return shaped.groupBy("shape").agg(F.sum("n").alias("n_values"), F.countDistinct("tokens").alias("n_token_patterns"))


def f21_edits(spark: SparkSession, folder: str) -> DataFrame:
    """substitutions between original and source text of one length, by the characters exchanged."""
    pairs = table(spark, folder, "manual_review_decisions").where("original_text IS NOT NULL AND source_text IS NOT NULL AND original_text <> source_text")
    edits = pairs.select("document", F.explode(text.edit_classes(F.col("original_text"), F.col("source_text"))).alias("e"))
    return edits.groupBy("e.from", "e.to").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("document").alias("n_documents"))


def f22_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """how alike the two witnesses of a decision are; equal pairs don't reach the UDF."""
    pairs = table(spark, folder, "manual_review_decisions").where("original_text IS NOT NULL AND source_text IS NOT NULL")
    a, b = text.engine_text(F.col("original_text")), text.engine_text(F.col("source_text"))
    pairs = pairs.select("decision_id", a.alias("a"), b.alias("b"))
    same = pairs.where("a = b").select("decision_id", F.lit(1.0).alias("ratio"))
    other = pairs.where("a <> b").select("a", "b").distinct().withColumn("ratio", F.round(udfs.similarity("a", "b"), 6))
    return same.unionByName(pairs.where("a <> b").join(other, ["a", "b"]).select("decision_id", "ratio"))


def f20_edit_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """edit scripts that lead from the original to the source text of decisions, by how often; distinct pairs only reach the UDF."""
    pairs = table(spark, folder, "manual_review_decisions").select(text.squash(F.col("original_text")).alias("a"), text.squash(F.col("source_text")).alias("b")).where("a <> b")
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("script", udfs.edits("a", "b"))
    return counted.groupBy("script").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pairs"))


def f37_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """values of the value index by the signature of their special characters."""
    values = table(spark, folder, "value_index").groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("signature", text.special_signature(F.col("value")))
    return values.where("signature <> ''").groupBy("signature").agg(F.sum("n").alias("n"))


def f24_stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Stable ids of table cells, entity ids of their values, numbers as doubles."""
    c = F.col
    rows = value_cells(spark, folder)
    return rows.select("occurrence_id", text.stable_id(c("document_id"), c("page"), c("table_index"), c("source_row_index"), c("column_index")).alias("cell_id"), text.entity_id(c("value")).alias("entity_id"), text.safe_double(c("value")).alias("number"))


def f27_pages(spark: SparkSession, folder: str) -> DataFrame:
    """pages in their canonical form and the text that counts for each decision."""
    rows = table(spark, folder, "manual_review_decisions")
    return rows.select("decision_id", text.page_key(F.col("page")).alias("page_key"), text.first_text(F.col("verified_text"), F.col("source_text"), F.col("original_text")).alias("text"))


def f28_query_values(spark: SparkSession, folder: str) -> DataFrame:
    """the value and the content words of a command about each entity."""
    values = table(spark, folder, "entities").where("display_value IS NOT NULL").select("display_value").distinct()
    question = F.concat(F.lit("Show  everything about '"), F.col("display_value"), F.lit("'"))
    return values.select("display_value", text.query_value(question).alias("asked"), F.array_join(text.content_words(question), " ").alias("words"))


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_with_header(fields_of(spark, folder))


def h1_row_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """H1, H2: ratios and label evidence of every row."""
    rows = profile.row_ratios(_cells(spark, folder))
    return rows.select("table_id", "row_index", *(F.round(c, 4).alias(c) for c in ("filled_ratio", "text_ratio", "number_ratio", "code_ratio", "label_evidence")), F.array_join("types", ",").alias("types"))


def h3_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """H3: agreement of the rows below each possible header."""
    return profile.column_agreement(_cells(spark, folder)).select("table_id", "row_index", F.round("agreement", 4).alias("agreement"))


def h5_headers(spark: SparkSession, folder: str) -> DataFrame:
    """H4, H5: the header row found in each table."""
    return profile.detect_headers(_cells(spark, folder)).select("table_id", "header_row", F.round("score", 3).alias("score"), "detected")


def h6_column_profile(spark: SparkSession, folder: str) -> DataFrame:
    """H6, H7: profile, role scores and primary role of every column."""
    scores = [f"{r}_score" for r in profile.ROLES]
    found = profile.column_profiles(fields_of(spark, folder), ["table_id", "column_index"], "value")
    return found.select("table_id", "column_index", "values", "distinct_values", *(F.round(s, 3).alias(s) for s in scores), "primary_role")


def h9_tables(spark: SparkSession, folder: str) -> DataFrame:
    """H8, H9: tables split into header and data, with counts."""
    split = profile.split_tables(_cells(spark, folder))
    rows = split.groupBy("table_id", "row_index", "row_type").agg(F.count(F.lit(1)).alias("n"), F.max("column_index").alias("width"))
    return rows.groupBy("table_id").agg(F.sum("n").alias("n_cells"), F.count(F.when(F.col("row_type") == "data", 1)).alias("n_data_rows"), F.max("width").alias("width"))


def h10_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Identifier values of each record, the best column first."""
    fields = fields_of(spark, folder)
    found = profile.identifier_fields(fields, profile.column_profiles(fields, ["table_id", "column_index"], "value"))
    best = F.max_by(F.struct("column_index", "value"), F.struct("score", (-F.col("column_index")).alias("left")))
    return found.groupBy("record_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_candidates")).select("record_id", "b.column_index", "b.value", "n_candidates")


def j22_record_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """The strong identifiers of each record by header."""
    fields = fields_of(spark, folder)
    return profile.record_identifiers(fields, profile.column_profiles(fields, ["table_id", "column_index"], "value"))


def agg1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    """AGG1: frequencies of every value."""
    return entities.frequencies(fields_of(spark, folder))


def _found(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    fields = materialize(fields_of(spark, folder), "fields")
    roles = profile.column_profiles(fields, ["table_id", "column_index"], "value")
    return fields, entities.candidates(entities.scored_occurrences(fields, roles))


def agg2_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """P8, AGG2: entity candidates with score, counts and evidence."""
    found = _found(spark, folder)[1]
    return found.select("canonical_value", "display_value", F.round("score", 3).alias("score"), "occurrence_count", "document_count", "table_count", F.array_join("evidence", ",").alias("evidence"))


def w1_numbered_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates numbered from the best on."""
    found = _found(spark, folder)[1].withColumn("score", F.round("score", 3))
    return entities.number_candidates(found).select("entity_candidate_id", "canonical_value", "rank")


def agg3_entity_links(spark: SparkSession, folder: str) -> DataFrame:
    """J2, AGG3, W4: entities linked to the fields that hold them."""
    fields, found = _found(spark, folder)
    return entities.entity_rollup(entities.link_entities(found, fields))


def j1_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each linked entity with ordered fields; links to missing records keep no fields."""
    links = table(spark, folder, "entity_links").where("entity_id IS NOT NULL AND record_id IS NOT NULL")
    joined = entities.retrieval_records(links, latest_records(table(spark, folder, "records")))
    return joined.select("entity_id", "record_id", "entity_column_index", "source_status", "field_count", F.array_join(F.transform("fields", lambda f: F.coalesce(f["value"], F.lit(""))), "|").alias("values"))


def j3_merged_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Linked occurrences against the fields of the records, what is in the record wins."""
    links = table(spark, folder, "entity_links").where("record_id IS NOT NULL AND column_index IS NOT NULL")
    once = entities.first_seen(links.select("record_id", "column_index", "link_id", "value", "source_status", "loaded_at"), ["record_id", "column_index"], ["link_id", "loaded_at", "value", "source_status"])
    return entities.merge_occurrences(once, fields_of(spark, folder), ["record_id", "column_index"])


def agg4_cross_documents(spark: SparkSession, folder: str) -> DataFrame:
    """J4, AGG4, W5: cross-document rollup of entities."""
    return entities.cross_document_rollup(table(spark, folder, "entities"), table(spark, folder, "entity_links"))


def agg5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """AGG5: size of the index."""
    return entities.index_statistics(table(spark, folder, "records"), fields_of(spark, folder))


def agg6_inverted_index(spark: SparkSession, folder: str) -> DataFrame:
    """AGG6, W6: places of each value key."""
    return entities.inverted_index(table(spark, folder, "value_index"))


QUERIES = {
    name: f
    for name, f in globals().copy().items()
    if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")
}

_KIND, _SCORE = q.value_type("text"), q.identifier_score("text")
_SHEET = (
    q.FIELDS
    + f""", sheet AS (
  SELECT table_id, row_index, column_index, text, {_KIND} AS kind, {_SCORE} >= 0.75 AS code FROM (
    SELECT table_id, source_row_index AS row_index, column_index, coalesce(value, '') AS text FROM field
    UNION ALL SELECT table_id, 1, column_index, coalesce(min(header), '') FROM field GROUP BY table_id, document_id, column_index)
)"""
)
_RATIOS = f""", ratio AS (
  SELECT table_id, row_index, count(*) FILTER (kind <> 'empty') / count(*) AS filled_ratio,
    coalesce(count(*) FILTER (kind = 'text') / nullif(count(*) FILTER (kind <> 'empty'), 0), 0) AS text_ratio,
    coalesce(count(*) FILTER (kind = 'number') / nullif(count(*) FILTER (kind <> 'empty'), 0), 0) AS number_ratio,
    coalesce(count(*) FILTER (code AND kind <> 'empty') / nullif(count(*) FILTER (kind <> 'empty'), 0), 0) AS code_ratio,
    coalesce((0.25 * count(*) FILTER (kind <> 'empty' AND length({q.squash("text")}) <= 40) + 0.25 * count(*) FILTER (kind <> 'empty' AND NOT {q.is_number("text")})
      + 0.20 * count(*) FILTER (kind <> 'empty' AND NOT code)) / nullif(count(*) FILTER (kind <> 'empty'), 0), 0) AS label_evidence,
    string_agg(kind, ',' ORDER BY column_index, kind) AS types
  FROM sheet GROUP BY table_id, row_index)"""
_AGREEMENT = """, placed AS (SELECT *, dense_rank() OVER (PARTITION BY table_id ORDER BY row_index) AS place FROM sheet),
below AS (SELECT table_id, c AS candidate, column_index, count(*) AS n, count(DISTINCT kind) AS kinds, bool_and(kind IN ('text', 'identifier_like')) AS mixed
  FROM placed, unnest([1, 2, 3]) AS u(c) WHERE kind <> 'empty' AND place > c AND place <= c + 5 GROUP BY ALL HAVING count(*) >= 2),
agreement AS (SELECT p.table_id, p.row_index, p.place AS candidate, coalesce(avg(CASE WHEN b.kinds = 1 THEN 1.0 WHEN b.mixed THEN 0.5 WHEN b.kinds IS NOT NULL THEN 0.0 END), 0.0) AS agreement
  FROM placed p LEFT JOIN below b ON b.table_id = p.table_id AND b.candidate = p.place AND b.column_index = p.column_index WHERE p.place <= 3 GROUP BY ALL)"""
_HEADERS = """, scored AS (SELECT table_id, row_index, candidate, agreement,
    round((0.20 * filled_ratio + 0.20 * label_evidence + 0.40 * agreement + 0.15 * text_ratio + 0.05 * (1 - code_ratio)) * CASE WHEN number_ratio >= 0.5 THEN 0.55 ELSE 1 END, 4) AS score
  FROM agreement JOIN ratio USING (table_id, row_index)),
header AS (SELECT DISTINCT ON (table_id) table_id, row_index, score, score >= 0.50 AND agreement >= 0.25 AS detected FROM scored ORDER BY table_id, score DESC, candidate)"""

_FREQUENCY = f""", keyed AS (SELECT *, {q.fold("value")} AS key FROM field),
frequency AS (SELECT key, count(*) AS value_frequency, count(DISTINCT document_id) AS document_frequency, count(DISTINCT (document_id, column_index)) AS context_frequency
  FROM keyed WHERE key <> '' GROUP BY key)"""

_PROFILE = f""", val AS (SELECT table_id, column_index, {q.squash("value")} AS text FROM field WHERE {q.squash("value")} <> ''),
spelled AS (SELECT table_id, column_index, {q.fold("text")} AS key, {_KIND} AS kind, {_SCORE} >= 0.75 AS code, length(text) <= 40 AS short FROM val),
per_key AS (SELECT table_id, column_index, key, count(*) AS n, count(*) FILTER (kind = 'number') AS number, count(*) FILTER (kind = 'date') AS date,
    count(*) FILTER (kind = 'boolean') AS boolean, count(*) FILTER (kind = 'text') AS txt, count(*) FILTER (code) AS code, count(*) FILTER (short) AS short FROM spelled GROUP BY ALL),
sums AS (SELECT table_id, column_index, sum(n) AS n, count(*) AS d, sum(number) / sum(n) AS num, sum(date) / sum(n) AS dat, sum(boolean) / sum(n) AS boo, sum(txt) / sum(n) AS txt,
    sum(code) / sum(n) AS cod, sum(short) / sum(n) AS sho, coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS rep, count(*) / sum(n) AS uni FROM per_key GROUP BY ALL),
role AS (SELECT table_id, column_index, n, d,
    round(least(1, 0.70 * cod + 0.30 * uni), 4) AS identifier_score, round(least(1, 0.85 * dat + 0.10 * uni + 0.05 * txt), 4) AS temporal_score,
    round(least(1, 0.85 * num + 0.10 * uni + 0.05 * (1 - boo)), 4) AS measurement_score, round(least(1, 0.60 * txt + 0.30 * rep + 0.10 * (1 - cod)), 4) AS categorical_score,
    round(least(1, (0.55 * txt + 0.25 * sho + 0.20 * (1 - cod)) * CASE WHEN num >= 0.75 THEN 0.2 ELSE 1 END * CASE WHEN dat >= 0.75 THEN 0.2 ELSE 1 END), 4) AS parameter_score,
    round(least(1, 0.70 * boo + 0.30 * (0.60 * txt + 0.30 * rep + 0.10 * (1 - cod))), 4) AS status_score FROM sums)"""
_ROLES = ", ".join(f"round({r}_score, 3) AS {r}_score" for r in profile.ROLES)
_BEST = "greatest(" + ", ".join(f"{r}_score" for r in profile.ROLES) + ")"
_PRIMARY = "CASE " + " ".join(f"WHEN {r}_score = {_BEST} THEN '{r}'" for r in profile.ROLES) + " END"

_TERMS = [
    ("identifier_role", "i >= 0.60", "0.65 * i"),
    ("identifier_like_value", "code", "0.20"),
    ("repeated_value", "value_frequency >= 2", "least(0.10, 0.025 * value_frequency)"),
    ("repeated_column_context", "context_frequency >= 2", "0.05"),
    ("cross_document_occurrence", "document_frequency >= 2", "0.10"),
    ("temporal_suppression", f"(t >= 0.70 OR {q.temporal_like('value')})", "-0.35"),
    ("measurement_suppression", f"(m >= 0.70 OR {q.numeric_like('value')})", "-0.45"),
    ("status_suppression", "(s >= 0.80 AND i < 0.60 AND NOT code)", "-0.20"),
    ("parameter_suppression", "(p >= 0.80 AND i < 0.60 AND NOT code)", "-0.10"),
    ("categorical_penalty", "(c >= 0.80 AND i < 0.60 AND NOT code)", "-0.05"),
]
_CANDIDATES = (
    q.FIELDS
    + _FREQUENCY
    + _PROFILE
    + f""", joined AS (SELECT k.*, f.* EXCLUDE (key), coalesce(identifier_score, 0) AS i, coalesce(temporal_score, 0) AS t, coalesce(measurement_score, 0) AS m,
    coalesce(categorical_score, 0) AS c, coalesce(parameter_score, 0) AS p, coalesce(status_score, 0) AS s, {q.code_like("value")} AS code
  FROM keyed k JOIN frequency f ON f.key = k.key LEFT JOIN role r ON r.table_id = k.table_id AND r.column_index = k.column_index),
points AS (SELECT *, greatest(0, least(1, {" + ".join(f"CASE WHEN {w} THEN {v} ELSE 0 END" for _, w, v in _TERMS)})) AS score,
    list_filter([{", ".join(f"CASE WHEN {w} THEN '{n}' END" for n, w, _ in _TERMS)}], lambda x: x IS NOT NULL) AS evidence FROM joined),
kept AS (SELECT * FROM points WHERE score >= 0.60),
spelling AS (SELECT key, {q.squash("value")} AS spelling, count(*) AS n FROM kept GROUP BY ALL),
display AS (SELECT DISTINCT ON (key) key, spelling AS display_value FROM spelling ORDER BY key, n DESC, spelling),
candidate AS (SELECT key AS canonical_value, display_value, round(max(score), 6) AS score, count(*) AS occurrence_count, count(DISTINCT document_id) AS document_count,
    count(DISTINCT (document_id, table_id)) AS table_count, list_sort(list_distinct(flatten(list(evidence)))) AS evidence FROM kept JOIN display USING (key) GROUP BY key, display_value)"""
)
_V = "SELECT DISTINCT value FROM value_index WHERE value IS NOT NULL"
_NUM = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"

SQL = {
    "f1_text_forms": f"SELECT value, {q.squash('value')} AS squashed, {q.fold('value')} AS folded, lower({q.squash(chr(39).join(['regexp_replace(value, ', '[|¦]', ', ', ' ', ', ', 'g', ')']))}) AS engine FROM ({_V})",
    "f8_value_types": f"""SELECT kind, score, sum(n) AS n_values, count(*) AS n_distinct FROM (SELECT {q.value_type("value")} AS kind, CAST({q.identifier_score("value")} AS DOUBLE) AS score, count(*) AS n
      FROM value_index GROUP BY value) GROUP BY kind, score""",
    "f9_candidate_looks": rf"""SELECT value, {q.numeric_like("value")} AS is_numeric, {q.temporal_like("value")} AS is_temporal, {q.code_like("value")} AS is_code,
      regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND (regexp_matches(value, '[_:/.\-]') OR regexp_matches(value, '[A-Za-z][0-9]|[0-9][A-Za-z]')) AS is_identifier FROM ({_V})""",
    "f14_class_strings": rf"""SELECT regexp_replace(regexp_replace(regexp_replace({q.squash("value")}, '\p{{L}}', 'L', 'g'), '\p{{N}}', 'N', 'g'), '[\s\p{{Z}}]', 'W', 'g') AS classes, count(*) AS n_values
      FROM value_index WHERE value IS NOT NULL GROUP BY 1""",
    "f13_symbols": rf"""SELECT sign, count(*) AS n_values, bool_or(contains('{text.HIGH_RISK}', sign)) AS high_risk FROM (
      SELECT unnest(list_distinct(regexp_extract_all(value, '[^\s\x0b\x{{85}}\p{{Z}}\p{{L}}\p{{N}}_/:.,\-]'))) AS sign FROM value_index) GROUP BY sign""",
    "f21_edits": f"""WITH pair AS (SELECT document, {q.squash("original_text")} AS a, {q.squash("source_text")} AS b FROM manual_review_decisions
        WHERE original_text IS NOT NULL AND source_text IS NOT NULL AND original_text <> source_text),
      place AS (SELECT document, a, b, unnest(range(1, length(a) + 1)) AS i FROM pair WHERE length(a) = length(b))
      SELECT substr(a, i, 1) AS "from", substr(b, i, 1) AS "to", count(*) AS n, count(DISTINCT document) AS n_documents FROM place WHERE substr(a, i, 1) <> substr(b, i, 1) GROUP BY 1, 2""",
    "f24_stable_ids": q.CELLS
    + f""" SELECT occurrence_id, sha1(concat_ws(chr(31), {", ".join(q.squash(f"CAST({c} AS VARCHAR)") for c in ("document_id", "page", "table_index", "source_row_index", "column_index"))})) AS cell_id,
      'entity_' || substr(sha1({q.fold("value")}), 1, 24) AS entity_id, CASE WHEN regexp_matches(value, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]?\\s*$') THEN TRY_CAST(value AS DOUBLE) END AS number FROM cell""",
    "f27_pages": f"""SELECT decision_id, CASE WHEN TRY_CAST({q.squash("page")} AS DOUBLE) = floor(TRY_CAST({q.squash("page")} AS DOUBLE)) THEN CAST(CAST(TRY_CAST({q.squash("page")} AS DOUBLE) AS BIGINT) AS VARCHAR)
      ELSE {q.squash("page")} END AS page_key, coalesce(nullif({q.squash("verified_text")}, ''), nullif({q.squash("source_text")}, ''), nullif({q.squash("original_text")}, ''), '') AS text FROM manual_review_decisions""",
    "h1_row_ratios": _SHEET
    + _RATIOS
    + " SELECT table_id, row_index, round(filled_ratio, 4) AS filled_ratio, round(text_ratio, 4) AS text_ratio, round(number_ratio, 4) AS number_ratio, round(code_ratio, 4) AS code_ratio, round(label_evidence, 4) AS label_evidence, types FROM ratio",
    "h3_agreement": _SHEET + _AGREEMENT + " SELECT table_id, row_index, round(agreement, 4) AS agreement FROM agreement",
    "h5_headers": _SHEET + _RATIOS + _AGREEMENT + _HEADERS + " SELECT table_id, CASE WHEN detected THEN row_index END AS header_row, round(score, 3) AS score, detected FROM header",
    "h6_column_profile": q.FIELDS + _PROFILE + f' SELECT table_id, column_index, n AS "values", d AS distinct_values, {_ROLES}, {_PRIMARY} AS primary_role FROM role',
    "h9_tables": _SHEET
    + _RATIOS
    + _AGREEMENT
    + _HEADERS
    + """ SELECT s.table_id, count(*) AS n_cells, count(DISTINCT s.row_index) FILTER (NOT (h.detected AND s.row_index = h.row_index)) AS n_data_rows, max(column_index) AS width
      FROM sheet s JOIN header h USING (table_id) GROUP BY s.table_id""",
    "h10_identifiers": q.FIELDS
    + _PROFILE
    + f""" SELECT DISTINCT ON (record_id) record_id, column_index, value, count(*) OVER (PARTITION BY record_id) AS n_candidates FROM field JOIN role USING (table_id, column_index)
      WHERE identifier_score >= 0.60 AND {q.squash("value")} <> '' ORDER BY record_id, identifier_score DESC, column_index""",
    "f37_signatures": f"""WITH v AS (SELECT array_to_string(list_transform(regexp_extract_all({q.squash("value")}, '[\\p{{S}}\\p{{P}}\\p{{M}}]'), lambda c: CASE WHEN unicode(c) > 127 THEN printf('U+%04X', unicode(c)) END), '|') AS signature FROM value_index)
      SELECT signature, count(*) AS n FROM v WHERE signature <> '' GROUP BY 1""",
    "j22_record_identifiers": q.FIELDS
    + _PROFILE
    + f""" SELECT record_id, {q.label("header")} AS header, arg_max({q.fold("value")}, (column_index, {q.fold("value")})) AS value FROM field JOIN role USING (table_id, column_index)
      WHERE identifier_score >= 0.80 AND {q.fold("value")} <> '' AND {q.label("header")} <> '' GROUP BY 1, 2""",
    "f28_query_values": f"""WITH v AS (SELECT DISTINCT display_value FROM entities WHERE display_value IS NOT NULL),
      w AS (SELECT display_value, regexp_extract_all({q.fold("'Show  everything about ' || display_value")}, '[a-z0-9]+') AS ws FROM v)
      SELECT display_value, trim(display_value) AS asked, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i AND length(x) > 1
        AND NOT list_contains([{", ".join(repr(x) for x in text.STOP_WORDS)}], x)), ' ') AS words FROM w""",
    "agg1_frequencies": q.FIELDS + _FREQUENCY + " SELECT * FROM frequency",
    "agg2_candidates": _CANDIDATES + " SELECT canonical_value, display_value, round(score, 3) AS score, occurrence_count, document_count, table_count, array_to_string(evidence, ',') AS evidence FROM candidate",
    "w1_numbered_candidates": _CANDIDATES
    + """, ranked AS (SELECT canonical_value, row_number() OVER (ORDER BY round(score, 3) DESC, occurrence_count DESC, encode(canonical_value)) AS rank FROM candidate)
      SELECT printf('entity_%06d', rank) AS entity_candidate_id, canonical_value, rank FROM ranked""",
    "agg3_entity_links": _CANDIDATES
    + f""", linked AS (SELECT DISTINCT ON (c.canonical_value, record_id, column_index) c.canonical_value, k.document_id, k.table_index, k.record_id FROM keyed k JOIN candidate c ON c.canonical_value = k.key)
      SELECT 'entity_' || substr(sha1({q.fold("canonical_value")}), 1, 24) AS entity_id, canonical_value, count(*) AS occurrence_count, count(DISTINCT document_id) AS document_count,
        count(DISTINCT (document_id, table_index)) AS table_count, count(DISTINCT record_id) AS record_count,
        CASE WHEN count(DISTINCT document_id) > 1 THEN 'cross_document' ELSE 'single_document' END AS link_status FROM linked GROUP BY canonical_value""",
    "j1_retrieval": q.FIELDS
    + """, held AS (SELECT record_id, count(*) AS field_count, string_agg(coalesce(value, ''), '|' ORDER BY column_index) AS "values" FROM field GROUP BY record_id),
      once AS (SELECT entity_id, record_id, min(column_index) AS entity_column_index FROM entity_links WHERE entity_id IS NOT NULL AND record_id IS NOT NULL GROUP BY ALL)
      SELECT o.entity_id, o.record_id, entity_column_index, coalesce(l.source_status, 'UNKNOWN') AS source_status, CAST(coalesce(field_count, 0) AS INTEGER) AS field_count, coalesce("values", '') AS "values"
      FROM once o LEFT JOIN latest l USING (record_id) LEFT JOIN held USING (record_id)""",
    "j3_merged_occurrences": q.FIELDS
    + """, once AS (SELECT DISTINCT ON (record_id, column_index) * FROM entity_links WHERE record_id IS NOT NULL AND column_index IS NOT NULL ORDER BY record_id, column_index, link_id, loaded_at, value NULLS FIRST, source_status NULLS FIRST)
      SELECT coalesce(f.record_id, o.record_id) AS record_id, coalesce(f.column_index, o.column_index) AS column_index, coalesce(f.value, o.value) AS value,
        coalesce(f.source_status, o.source_status, 'UNKNOWN') AS source_status, f.value IS NOT NULL AS is_verified
      FROM once o FULL JOIN field f ON f.record_id = o.record_id AND f.column_index = o.column_index""",
    "agg4_cross_documents": """WITH own AS (SELECT entity_id, max(canonical_value) AS canonical_value FROM entities WHERE entity_id IS NOT NULL GROUP BY entity_id),
      place AS (SELECT entity_id, document_id, page, table_id, source_row_index, max(normalized_value) AS value FROM entity_links WHERE entity_id IS NOT NULL GROUP BY ALL),
      counts AS (SELECT entity_id, count(*) AS o, count(DISTINCT document_id) AS d, count(DISTINCT CASE WHEN document_id IS NOT NULL AND page IS NOT NULL AND table_id IS NOT NULL THEN (document_id, page, table_id) END) AS t, max(value) AS value FROM place GROUP BY entity_id)
      SELECT entity_id, coalesce(canonical_value, value) AS canonical_value, coalesce(o, 0) AS occurrence_count, coalesce(d, 0) AS document_count, coalesce(t, 0) AS table_count, coalesce(d, 0) > 1 AS cross_document
      FROM own FULL JOIN counts USING (entity_id)""",
    "agg5_statistics": q.FIELDS
    + f""" SELECT 'documents' AS statistic, count(DISTINCT document_id) AS n FROM records UNION ALL SELECT 'tables', count(DISTINCT table_id) FROM records
      UNION ALL SELECT 'records', count(DISTINCT record_id) FROM records UNION ALL SELECT 'fields', count(*) FROM field
      UNION ALL SELECT 'distinct_values', count(DISTINCT nullif({q.fold("value")}, '')) FROM field""",
    "agg6_inverted_index": f"SELECT DISTINCT {q.fold('value')} AS key, document_id, table_id, table_index, page, source_row_index, column_index FROM value_index WHERE {q.fold('value')} <> ''",
}
