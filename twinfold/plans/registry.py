"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from twinfold.operators import balanced, corpus, embed, encode, files, graph, graph_pairs, models, order, pairs, stats, structure, vectors, wording
from twinfold.streaming import windows

_PARTS = (balanced, pairs, wording, corpus, graph, graph_pairs, order, stats, encode, vectors, embed, structure, models, files, windows)
QUERIES = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
SQL = {k: v for m in _PARTS for k, v in getattr(m, "SQL", {}).items()}
