"""Queries in SQL alone, by the functions that the library registers."""

from __future__ import annotations

from narrata.functions import sql
from narrata.plans.dialogue_queries import query
from narrata.plans.text_queries import MADE
from narrata.sources.dialogue import table
from narrata.sources.model import frame


@query(MADE + "SELECT book, start_cp, end_cp, delimiter = 'corner_bracket' AS corner, depth FROM kept")
def fn_sql_scan_quotes(s, d):
    """Quotes by a table function over segments in order."""
    sql.register(s)
    return s.sql("SELECT book, start_cp, end_cp, opening = '「' AS corner, depth FROM scan_quotes(TABLE(SELECT book, turn, seg FROM {story}) PARTITION BY book ORDER BY turn)", story=frame(s, d, "story"))


@query("""SELECT doc_id, CAST(k AS BIGINT) AS sentence, CAST(e - length(s) AS BIGINT) AS start_cp, CAST(e AS BIGINT) AS end_cp, sha256(s) AS digest FROM (SELECT doc_id, k, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
  SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？!?\\n]*[。！？!?\\n]|[^。！？!?\\n]+$') AS p FROM documents)) WHERE s <> '')""")
def fn_sql_split_sentences(s, d):
    """Sentences by a table function."""
    sql.register(s)
    return s.sql("SELECT key AS doc_id, sentence, start_cp, end_cp, sha2(text, 256) AS digest FROM split_sentences(TABLE(SELECT doc_id, text FROM {docs}))", docs=table(s, d, "documents"))


@query("""SELECT lang, CAST(sum(w + CAST(floor((length(text) - w + 3) / 4) AS BIGINT)) AS BIGINT) AS tokens, count(*) AS texts, 'utf-8' AS encoding FROM (
  SELECT lang, text, length(text) - length(regexp_replace(text, '[\\x{3400}-\\x{9FFF}\\x{3040}-\\x{30FF}\\x{3000}-\\x{303F}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}\\x{20000}-\\x{2FA1F}]', '', 'g')) AS w FROM documents) GROUP BY 1""")
def fn_sql_tokens_of_bytes(s, d):
    """Bytes decoded, and their tokens estimated, by functions in SQL."""
    sql.register(s)
    return s.sql("SELECT lang, sum(estimate_tokens(t.text)) AS tokens, count(*) AS texts, max(t.encoding) AS encoding FROM (SELECT lang, decode_text(encode(text, 'UTF-8')) AS t FROM {docs}) GROUP BY lang", docs=table(s, d, "documents"))
