"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from rankspark.llm import queries_native, queries_records, queries_text

QUERIES = {**queries_native.QUERIES, **queries_text.QUERIES, **queries_records.QUERIES}
ORACLES = {**queries_native.ORACLES, **queries_text.ORACLES, **queries_records.ORACLES}
