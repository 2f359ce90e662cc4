"""Registered queries over the given tables, each beside its SQL where SQL can
express it. `QUERIES` maps a name to a function of (spark, folder), `ORACLES`
maps it to the SQL.
"""

from headwater.queries import causal, cleaning, features, ingest, ledger, models, scoring, series, sinks, streams

_MODULES = (series, cleaning, features, scoring, ledger, causal, models, ingest, sinks, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in _MODULES for name, text in module.ORACLES.items()}
