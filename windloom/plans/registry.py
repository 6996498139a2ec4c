"""The registered queries of the core and their SQL."""

from __future__ import annotations

from windloom.plans import documents, layouts, measurements, requests, retrieval

PARTS = [documents, retrieval, measurements, requests, layouts]
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in PARTS for name, sql in getattr(part, "ORACLE", {}).items()}


def flagship(spark, sf):
    """Hybrid retrieval: term overlap and BM25 ranks of every query text, fused."""
    return retrieval.rrf_fusion(spark, sf)
