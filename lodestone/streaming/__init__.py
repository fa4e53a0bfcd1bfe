"""Incremental forms of operators."""
