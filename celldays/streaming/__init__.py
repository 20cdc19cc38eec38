"""Structured Streaming forms of operators whose input arrives day by day."""
