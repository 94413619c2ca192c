"""Incremental intake of result files that keep arriving."""
