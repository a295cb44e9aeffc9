"""Registered queries, one per operator, with their SQL counterparts."""

from daygrid.catalog import evaluate, export, grid, labels, masks, records, splits, stats, storage, windows  # noqa: F401
from daygrid.catalog.registry import ORACLES, QUERIES  # noqa: F401
