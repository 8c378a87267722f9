"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["exact_dedup", "packing", "mixing", "chat_format", "html_extract", "toxicity", "language_id", "fingerprints", "licence_scan", "jaccard_join"]


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"textloom.llm.{m}"), name, {}).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
