"""All registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from tracewell.plans import catalog, composites, evidence, ledgers, qualification, recordings, sequences, signals, statistics
from tracewell.streaming import windows

MODULES = (catalog, evidence, sequences, statistics, qualification, signals, recordings, composites, ledgers, windows)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
