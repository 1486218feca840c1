"""The registered queries and their SQL counterparts."""

from rillstone.plans import basics, files, joins, reports, rides, rolling, scoring, streams, windows

_MODULES = (basics, joins, rolling, scoring, windows, streams, reports, rides, files)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
