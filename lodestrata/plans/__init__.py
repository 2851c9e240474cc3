"""Queries over the standard tables, each with the SQL that gives the same rows."""

from . import graphs, numeric, surfaces, texts

QUERIES = numeric.QUERIES | texts.QUERIES | graphs.QUERIES | surfaces.QUERIES
ORACLES = numeric.ORACLES | texts.ORACLES | graphs.ORACLES | surfaces.ORACLES
