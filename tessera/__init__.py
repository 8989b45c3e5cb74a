"""Hybrid retrieval, knowledge-graph analytics and corpus preparation as Spark DataFrame plans."""
