"""All registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from . import addressing, answering, beliefs, claims, corpus, evaluation, extraction, framing, graph, learning, linking, retrieval, routing, selection, streams, vectors  # noqa: F401
from ._base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
