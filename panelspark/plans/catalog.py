"""Imports every module that registers queries."""

from panelspark.plans import q_features, q_functions, q_ingest, q_market, q_models, q_panel, q_signals
from panelspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_features", "q_functions", "q_ingest", "q_market", "q_models", "q_panel", "q_signals"]
