"""Structured Streaming on the same operators and metric definitions as batch runs."""
