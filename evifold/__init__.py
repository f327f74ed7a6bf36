"""Spark-first engine for retrieval corpora, agent trajectories and their evaluation."""
