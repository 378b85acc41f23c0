"""Queries of this subpackage and the SQL each is compared with."""

from __future__ import annotations

from . import components, cooccur, frequency, knn, mixing, packing, pii, quality, topn

_MODULES = (knn, topn, cooccur, frequency, pii, components, packing, mixing, quality)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
