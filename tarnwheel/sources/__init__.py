"""Scans, sinks, the query corpus, event records and synthetic tables."""
