"""Queries over the tables, each with its SQL where SQL can express it."""

from . import geometry, images, measures, solvers, streams

MODULES = (measures, images, geometry, solvers, streams)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
