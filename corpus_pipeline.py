"""Corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from quillspark.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
