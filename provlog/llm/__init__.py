"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes DataFrames and
returns DataFrames; the contract queries live in :mod:`provlog.llm.queries`.
"""
