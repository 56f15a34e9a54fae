"""The registered queries of the engine's own operators, with their SQL."""

from tessel.queries import dense, incremental, index, lexical, retrieval, text
from tessel.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "dense", "incremental", "index", "lexical", "retrieval", "text"]
