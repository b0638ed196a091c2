"""Retrieval, document and record analytics as Spark DataFrame plans."""
