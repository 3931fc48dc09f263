"""Query registry: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

from .plans import detection, learning, messages, readout, receivers, recordings, signals, spectral

_MODULES = (detection, readout, spectral, signals, learning, messages, receivers, recordings)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
