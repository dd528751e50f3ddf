"""Taint flows over function summaries."""
