"""Operators on DataFrames: scoring, lookups, cascades, statistics, request-log analytics."""
