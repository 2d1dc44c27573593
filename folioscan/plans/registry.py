"""All queries of the engine by name, with their SQL counterparts."""

from __future__ import annotations

from folioscan.plans import answers, catalog, corpus, dialogue, durable, layout, retrieval, structure
from folioscan.plans.base import ORACLES, QUERIES

FLAGSHIP = "keyword_topk"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "answers", "catalog", "corpus", "dialogue", "durable", "layout", "retrieval", "structure"]
