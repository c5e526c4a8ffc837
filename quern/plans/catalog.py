"""Importing this module registers all queries."""

from quern.plans import comparisons, evaluation, lineage, programs, relations, sequences, storage, summaries  # noqa: F401
