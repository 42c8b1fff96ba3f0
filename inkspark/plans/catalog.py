"""All queries and SQL twins of the engine."""

from inkspark.plans import cards, imaging, reading, records, scoring, screening, service, stores, trails, zones
from inkspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cards", "imaging", "reading", "records", "scoring", "screening", "service", "stores", "trails", "zones"]
