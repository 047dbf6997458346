"""All registered queries of the knowledge and conversation operators, with their oracles."""

from __future__ import annotations

from quillspark.plans import inventory_queries, question_queries, retrieval_queries, section_queries, session_queries, text_queries, verify_queries

MODULES = (text_queries, section_queries, inventory_queries, retrieval_queries, question_queries, verify_queries, session_queries)
FLAGSHIP = "r1_hybrid_search"
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
