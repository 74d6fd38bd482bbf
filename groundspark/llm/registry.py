"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, exact_dedup, html_extract, license_scan, periodic_runs, pii, quality, sharding, simhash, spelling, token_output

#: Words of a lower-cased text, as in _common.words_of, for DuckDB.
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+')"

OP5_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 5) AS k FROM item_words WHERE len(w) > 0),
item_grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_grams AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM doc_grams JOIN item_grams USING (k, g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, n AS n_shingles, shared / n AS containment FROM hits JOIN sizes USING (item_id) WHERE shared >= 0.8 * n - 1e-9
"""

OP8_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), chr(10), '\n') AS er, replace(replace(text, '\', '\b'), '<', '\l') AS et FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(6 + length(er) + 1 + length(et) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_html_extract": html_extract.op2_html_extract,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_simhash": simhash.op6_simhash,
        "op7_bpe": bpe.op7_bpe,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_token_output": token_output.op9_token_output,
        "op10_pii": pii.op10_pii,
        "op11_sharding": sharding.op11_sharding,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op5_decontaminate": OP5_SQL, "op8_chat_format": OP8_SQL}
