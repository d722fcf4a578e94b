"""All queries in one registry."""

from __future__ import annotations

from . import archive_queries, catalog_queries, job_queries, raster_queries, stream_queries
from .fixtures import Registry

ALL = Registry()
for module in (raster_queries, archive_queries, catalog_queries, job_queries, stream_queries):
    ALL.queries.update(module.REG.queries)
    ALL.checks.update(module.REG.checks)
