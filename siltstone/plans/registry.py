"""All registered queries of the core, with their SQL."""

from siltstone.plans import knowledge, p5, reference

_MODULES = [p5, reference, knowledge]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
