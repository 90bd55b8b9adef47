"""The text rules of ``functions.text`` written in DuckDB SQL, for the check of queries against SQL."""

from lodestrata.functions import text

_SPACE = r"[\s\x0b\x{85}\p{Z}]+"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
_PLAIN = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g'))"


def fold(x: str) -> str:
    return f"translate(replace(lower({squash(x)}), 'ß', 'ss'), 'ςµ', 'σμ')"


def label(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({x}, '')), '°', ' degree '), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Join_C}}]+', ' ', 'g'))".replace(r"\p{Join_C}", "")


def repair_mojibake(x: str) -> str:
    t = x
    for garbled, symbol in text.mojibake():
        t = f"replace({t}, '{garbled}', '{symbol}')"
    t = f"replace(replace({t}, '°℃', '°C'), '℃', '°C')"
    return f"coalesce(CASE WHEN regexp_matches({x}, '[ÂÃÎÏâ℃]') THEN {t} ELSE {x} END, '')"


def is_number(x: str) -> str:
    cleaned = f"trim(replace(translate({squash(x)}, '−–', '--'), ',', ''))"
    return rf"regexp_matches({cleaned}, '^{_PLAIN}(\s*[^0-9\s]{{1,8}})?$')"


def is_date(x: str) -> str:
    return rf"regexp_matches({squash(x)}, '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}|(?i:{_MONTH}[- /][0-9]{{2,4}}))$')"


def identifier_score(x: str) -> str:
    t = squash(x)
    return rf"""CASE WHEN {t} = '' OR length({t}) > 120 OR {is_number(x)} OR {is_date(x)} THEN 0.0
      WHEN regexp_matches({t}, '^[A-Za-z0-9]+([-_/.:][A-Za-z0-9]+)+$') THEN 1.0
      WHEN NOT regexp_matches({t}, '^[A-Za-z0-9]{{2,32}}$') THEN 0.0
      WHEN regexp_matches({t}, '[0-9]') AND upper({t}) = {t} THEN 0.9
      WHEN regexp_matches({t}, '[0-9]') THEN 0.75
      WHEN upper({t}) = {t} AND length({t}) <= 12 THEN 0.55 ELSE 0.0 END"""


def value_type(x: str) -> str:
    booleans = ", ".join(f"'{b}'" for b in text.BOOLEANS)
    return f"""CASE WHEN {squash(x)} = '' THEN 'empty' WHEN {is_date(x)} THEN 'date' WHEN {is_number(x)} THEN 'number'
      WHEN {fold(x)} IN ({booleans}) THEN 'boolean' WHEN {identifier_score(x)} >= 0.75 THEN 'identifier_like' ELSE 'text' END"""


def numeric_like(x: str) -> str:
    t = f"regexp_replace(regexp_replace({squash(x)}, ',', '', 'g'), '[%°±Ωμλ∆]', '', 'g')"
    return rf"regexp_matches({t}, '^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:nan|inf(inity)?))\s*$')"


def temporal_like(x: str) -> str:
    return rf"regexp_matches(lower({squash(x)}), '^([0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}|[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}}|{_MONTH}[a-z]*[- ][0-9]{{4}}|[0-9]{{4}}[-/][0-9]{{1,2}})$')"


def code_like(x: str) -> str:
    t = squash(x)
    return rf"""({t} <> '' AND NOT {numeric_like(x)} AND NOT {temporal_like(x)} AND
      ((regexp_matches({t}, '[A-Za-z]') AND regexp_matches({t}, '\p{{Nd}}') AND length({t}) <= 80) OR regexp_matches({t}, '^[A-Za-z]{{1,12}}[-_/][A-Za-z0-9]{{1,24}}$')))"""


#: Latest state of each record, its non-null fields in long form, and each occurrence of the value index once.
FIELDS = """
WITH latest AS (SELECT DISTINCT ON (record_id) * FROM records WHERE record_id IS NOT NULL ORDER BY record_id, indexed_at DESC NULLS LAST, removed_at DESC NULLS LAST),
entry AS (SELECT record_id, source_status, document_id, page, table_id, table_index, source_row_index, unnest(map_entries(fields)) AS e FROM latest),
field AS (SELECT record_id, source_status, document_id, page, table_id, table_index, source_row_index,
                 CAST(regexp_extract(e.key, '([0-9]+)$', 1) AS INTEGER) AS column_index, e.value.header AS header, e.value.value AS value,
                 e.value.normalized_value AS normalized_value FROM entry WHERE e.value IS NOT NULL)"""
CELLS = """
WITH cell AS (SELECT DISTINCT ON (occurrence_id) * FROM value_index ORDER BY occurrence_id, loaded_at DESC NULLS LAST, value DESC NULLS LAST)"""
