"""Readings, event and snapshot tables."""
