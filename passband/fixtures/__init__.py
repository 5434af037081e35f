"""Telemetry made from the given tables, for the named queries and tests; no operator imports it."""
