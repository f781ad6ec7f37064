"""Scans, caches, fixtures and sinks."""
