"""Provenance-log analytics on Spark."""
