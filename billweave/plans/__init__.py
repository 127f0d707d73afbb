"""Registered queries and their reference SQL."""

from billweave.plans import core, documents, parsing

_MODULES = (core, documents, parsing)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in _MODULES for k, q in m.ORACLE.items()}
flagship = core.flagship
