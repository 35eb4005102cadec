"""Registered queries and their SQL."""

from wfscan.plans import audit, chains, mining, nested, records, rules, scan, similarity, small, streams, summary, taxonomy, workflow  # noqa: F401
from wfscan.plans.registry import QUERIES, SQL  # noqa: F401
