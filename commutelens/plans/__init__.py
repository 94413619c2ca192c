"""Whole analyses: example inputs, the registered queries and their SQL."""
