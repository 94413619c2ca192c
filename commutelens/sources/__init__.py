"""Readers and writers of feed, zone, travel-time and result files."""
