"""All registered queries and their SQL twins."""

from workloads import campaigns, directories, listings, more, states, texts, urls

MODULES = [urls, texts, listings, campaigns, directories, more, states]
QUERIES = {name: run for module in MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
