"""Loads all modules that register queries."""

from leafspan.plans import more_queries, outline_queries, session_queries, strategy_queries, text_queries, toc_queries  # noqa: F401
