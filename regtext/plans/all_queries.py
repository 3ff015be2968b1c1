"""Imports every module that registers queries."""

from regtext.plans import engine_queries, service_queries, text_queries  # noqa: F401

FLAGSHIP = engine_queries.vec_hybrid_boost
