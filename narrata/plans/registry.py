"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from narrata.plans import correction_queries, directory_queries, epub_queries, evaluation_queries, export_queries, gold_queries, identity_queries, identity_time_queries, layout_queries, ledger_queries, retrieval_queries, review_queries, sql_queries, stream_queries, text_queries, validation_queries, window_queries  # noqa: F401 (register their queries)
from narrata.plans.dialogue_queries import ORACLES, QUERIES

FLAGSHIP = "t1_quotes"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
