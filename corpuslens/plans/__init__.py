"""Registered queries; importing this package registers all of them."""

from corpuslens.plans import clusters, encode, enrich, ingest, neighbours, search, trends  # noqa: F401
from corpuslens.plans.registry import QUERIES, SQL  # noqa: F401
