"""Detectors: from fact rows to issue rows, as DataFrame operations."""
