"""Siltstone: a snapshot table format and analytics layer written for PySpark."""
