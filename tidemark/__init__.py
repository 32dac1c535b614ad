"""Batch and micro-batch analytics over event-like tables, built on PySpark."""
