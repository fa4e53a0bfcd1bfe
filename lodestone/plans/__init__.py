"""Whole runs, and the queries over the test tables."""
