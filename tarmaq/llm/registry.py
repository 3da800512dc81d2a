"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

import importlib

_MODULES = ["toxicity", "substring_dedup", "near_dedup", "mixing", "media", "quality", "packing", "token_counts", "line_dedup", "licenses"]


def _collected(kind: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out |= getattr(importlib.import_module(f"tarmaq.llm.{name}"), kind)
    return out


def queries() -> dict:
    """Name to function (spark, sf_dir) -> DataFrame."""
    import corpus_pipeline

    return _collected("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL, for the queries that SQL can express on whole tables."""
    import corpus_pipeline

    return _collected("ORACLES") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
