"""All queries of the core with their SQL."""

from __future__ import annotations

from baglight.plans import composed, curation, localisation, patchwork, pipeline, recognition

_MODULES = (recognition, localisation, curation, patchwork, composed, pipeline)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
