"""Retrieval, data-quality and corpus operators as Spark DataFrame transforms."""
