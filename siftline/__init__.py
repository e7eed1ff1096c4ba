"""Siftline: retrieval, ranking and test-outcome analytics as PySpark DataFrame plans."""
