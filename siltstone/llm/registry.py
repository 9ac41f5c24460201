"""All registered queries of the text operators, with their SQL."""

from siltstone.llm import p1, p2, p3, p4, p6, p7, p8

_MODULES = [p1, p2, p3, p4, p6, p7, p8]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
