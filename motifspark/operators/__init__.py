"""Operators on graph databases, patterns and embeddings."""
