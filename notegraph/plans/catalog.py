"""All named queries of the core operators."""

from notegraph.plans import q_engine, q_evaluation, q_graph, q_relations, q_scoring, q_statistics, q_text, q_vectors  # noqa: F401
from notegraph.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
