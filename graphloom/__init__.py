"""Subgraph patterns in large, changing graphs, as Spark DataFrame plans."""
