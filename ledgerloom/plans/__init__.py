"""Registered queries; importing the package registers all of them."""

from . import assembly_queries, detail_queries, markup_queries, queries, source_queries, upkeep_queries  # noqa: F401
