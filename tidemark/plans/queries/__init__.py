"""Registered queries, each with the SQL that gives the same result.

Importing the modules fills the registry.
"""

from tidemark.plans.queries import aggregates, events, incremental, marts, runs, summaries, volumes  # noqa: F401
