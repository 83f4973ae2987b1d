"""Operators for preparing text corpora at scale."""
