"""Registered queries. Importing this package registers them all."""

from . import q_docs, q_extras, q_git, q_graph, q_history, q_index, q_metrics, q_parse, q_rag, q_rules, q_sessions, q_sources, q_stores, q_streams, q_surface, q_text, q_vector  # noqa: F401
from .registry import REGISTRY, covered, oracle_sql, queries  # noqa: F401
