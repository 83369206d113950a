"""Named queries and their SQL."""

from __future__ import annotations

from quern.plans import answering, conversation, curation, documents, grouping, hierarchy, knowledge, learning, lifecycle, phrases, relational, retrieval, reviews, sources, streaming, text, workflow

FLAGSHIP = "r02_answer_retrieval"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for module in (text, retrieval, relational, conversation, documents, hierarchy, grouping, lifecycle, answering, knowledge, learning, phrases, reviews, workflow, curation, sources, streaming):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
