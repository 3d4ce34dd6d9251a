"""Assertion journal, dialogue and code retrieval, and evaluation as Spark DataFrame operators."""
