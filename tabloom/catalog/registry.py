"""All registered queries."""

from __future__ import annotations

from tabloom.catalog import choosing, features, ingest, modelling, profiling, results, timelines
from tabloom.catalog.common import Catalog


def catalog() -> Catalog:
    merged = Catalog()
    for module in (ingest, profiling, features, choosing, modelling, results, timelines):
        merged.update(module.CAT)
    return merged
