"""All queries of the library's own operators and their oracles."""

from __future__ import annotations

from . import document_queries, events_queries, note_queries, score_queries, song_queries  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
