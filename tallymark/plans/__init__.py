"""Registered queries over the test tables, and their SQL."""

from . import comparing, matching, reading

QUERIES = reading.QUERIES | comparing.QUERIES | matching.QUERIES
ORACLES = reading.ORACLES | comparing.ORACLES | matching.ORACLES
