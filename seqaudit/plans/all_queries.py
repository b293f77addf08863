"""Imports every module that registers queries."""

from .catalog import ORACLES, QUERIES  # noqa: F401
from . import similarity_queries, sequence_queries, ingest_queries, metric_queries, gate_queries, model_queries, candidate_queries, corpus_queries, campaign_queries  # noqa: F401
