"""Imports every query module so that all keys are registered."""

from __future__ import annotations

from . import (eval_queries, flow_queries, model_queries, packet_queries,  # noqa: F401
               sample_queries, stream_queries, train_queries, verdict_queries)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
