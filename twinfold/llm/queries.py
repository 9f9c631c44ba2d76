"""Queries and SQL of this subpackage."""

from __future__ import annotations

from twinfold.llm import bpe, copies, distinctive, groups, language, near, overlap, packing, together

_PARTS = (overlap, copies, groups, together, distinctive, near, bpe, packing, language)
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
SQL = {k: v for m in _PARTS for k, v in getattr(m, "SQL", {}).items()}
