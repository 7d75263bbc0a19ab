"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import ann, langid, mixing, packing, secrets, sharding, simhash, substrings, topk, warc

_MODULES = (warc, simhash, ann, mixing, sharding, substrings, packing, langid, secrets, topk)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
