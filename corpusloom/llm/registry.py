"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, embeddings, htmltext, langid, media, mixing, nearest, periodic, repeats, resampling, secrets, sharding, tokens

_MODULES = (repeats, sharding, secrets, htmltext, media, langid, decontaminate, nearest, tokens, mixing, resampling, periodic, embeddings)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
