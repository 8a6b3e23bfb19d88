"""Composite queries: monitoring, evaluation, gates, curation and data quality."""

from . import agent, checks, curation, evaluation, gates, memos, monitoring, quality, runs, signals, streams, traces, training, votes  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
