"""Every query of the engine with its SQL twin, by name."""

from cairn.plans import queries
from cairn.streaming import lookup as streaming

QUERIES = queries.QUERIES | streaming.QUERIES
ORACLES = queries.ORACLES | streaming.ORACLES
