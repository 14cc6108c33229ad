"""All queries of the raster engine with their SQL oracles."""

from __future__ import annotations

from . import dataflow_queries, earth_queries, metadata_queries, raster_queries

MODULES = (raster_queries, dataflow_queries, metadata_queries, earth_queries)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}
