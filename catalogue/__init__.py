"""Registered queries: each operator over the driver tables, with its SQL twin."""

from catalogue import corpus, log, streams, trade  # noqa: F401
from catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
