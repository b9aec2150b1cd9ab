"""The queries of this subpackage, one for each operator, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import op1_chat_format
from .chunk_bpe import op10_chunk_bpe
from .flac import op7_flac_media
from .language_id import op8_language_id
from .packing import op3_best_fit
from .quality_classifier import op5_quality_classifier
from .quality_rules import op4_quality_rules
from .simhash import op6_simhash
from .sst import op2_sst_shards
from .url_filter import op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_sst_shards, op3_best_fit, op4_quality_rules, op5_quality_classifier, op6_simhash, op7_flac_media, op8_language_id, op9_url_filter, op10_chunk_bpe)
}

#: What is escaped by one backslash: each first character before each of these ends, and a backslash itself.
_ENDS = ("s>", "/s>", "INST]", "/INST]", "SYS>>", "/SYS>>", "<SYS>>", "</SYS>>", "|")


def _escapes(column: str) -> str:
    """SQL for the number of characters that escaping adds; no control string overlaps itself."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{x}', ''))) // {len(x)}" for x in ("\\", *(a + b for a in "<[" for b in _ENDS)))


ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(role) + length(text) + {_escapes('role')} + {_escapes('text')}) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM c GROUP BY conv_id
""",
    "op9_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
)
SELECT s.page_id, s.host, s.path,
       (SELECT r.host || r.path FROM rules r
        WHERE (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path)
        ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.verdict FROM rules r
        WHERE (s.host = r.host OR s.host LIKE '%.' || r.host) AND starts_with(s.path, r.path)
        ORDER BY length(r.host || r.path) DESC LIMIT 1), 'allow') AS verdict
FROM split s
""",
}
