"""Registered queries, one module per part of the operator inventory."""

from scalemetrics.plans import adaptive, checks, evaluation, ingest, itemstats, learning, masking, population, reports, resampling, rows  # noqa: F401
from scalemetrics.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
