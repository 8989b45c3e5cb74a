"""All registered queries: importing the modules registers them."""

from tessera.plans import document_queries, graph_queries, queries, search_queries  # noqa: F401
from tessera.plans.registry import QUERIES, SQL  # noqa: F401
