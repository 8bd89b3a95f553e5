"""All registered queries and oracles."""

from workload import graph_queries, label_queries  # noqa: F401  (they register)
from workload.text_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
