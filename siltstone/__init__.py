"""Siltstone: source-repository analysis expressed as PySpark DataFrame jobs."""
