"""Concept-graph analytics over document collections, on Spark."""
