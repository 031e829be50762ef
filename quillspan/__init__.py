"""Semantic-corpus analytics as PySpark DataFrame operators."""
