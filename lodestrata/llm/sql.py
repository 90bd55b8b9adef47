"""DuckDB SQL of the text queries that SQL can express."""

_ENTRIES = """
WITH entry AS (
  SELECT decision_id, document, page, original_text, source_text, verified_text, human_decision,
         coalesce(recovered_from_historical_log, false) AS recovered, timestamp_utc FROM manual_review_decisions
  UNION ALL
  SELECT decision_id, payload ->> 'document', payload ->> 'page', payload ->> 'original_text', payload ->> 'source_text', payload ->> 'verified_text',
         payload ->> 'human_decision', coalesce(CAST(payload ->> 'recovered_from_historical_log' AS BOOLEAN), false), payload ->> 'timestamp_utc'
  FROM (SELECT decision_id, CAST(payload AS JSON) AS payload FROM ledger_lines)
),
"""


def _folded(column: str) -> str:
    """A mark between digits is fenced by a private character (twice, for marks two digits apart), then the rest goes."""
    text = f"replace(replace(lower(coalesce({column}, '')), 'ß', 'ss'), 'ς', 'σ')"
    for _ in range(2):
        text = rf"regexp_replace({text}, '(\p{{Nd}})(\p{{P}})(\p{{Nd}})', '\1\2' || chr(57344) || '\3', 'g')"
    text = rf"regexp_replace({text}, '\p{{P}}+([^\p{{P}}' || chr(57344) || ']|$)', '\1', 'g')"
    return rf"regexp_replace({text}, '[\s\p{{Z}}' || chr(57344) || chr(11) || chr(133) || ']', '', 'g')"


_GROUPS = (
    _ENTRIES
    + f"""grouped AS (
  SELECT *, min(decision_id) OVER same AS keep, count(*) OVER same AS copies FROM (
    SELECT *, {_folded("document")} AS d, {_folded("original_text")} AS o, {_folded("source_text")} AS s,
           coalesce(CAST(TRY_CAST(trim(page) AS DOUBLE) AS VARCHAR), trim(page), '') AS p FROM entry)
  WINDOW same AS (PARTITION BY d, p, o, s)
)
"""
)
_PREFERRED = "(recovered, coalesce(-epoch_us(TRY_CAST(trim(timestamp_utc) AS TIMESTAMPTZ)), 9223372036854775807), decision_id)"
_BLANK = r"regexp_matches({0}, '[^\s\p{{Z}}]')"

SQL = {
    "p5_found": _GROUPS + "SELECT keep AS keep_id, decision_id AS copy_id FROM grouped WHERE keep < decision_id",
    "p5_counts": _GROUPS + "SELECT keep AS keep_id, copies FROM grouped WHERE keep = decision_id",
    "p2_found": _GROUPS
    + f"""SELECT keep AS group_id, arg_min(decision_id, {_PREFERRED}) FILTER ({_BLANK.format("verified_text")}) AS text_from,
       arg_min(decision_id, {_PREFERRED}) FILTER ({_BLANK.format("human_decision")}) AS decision_from
FROM grouped WHERE copies > 1 GROUP BY keep""",
}
